"""Mixing sources to target weights by temperature."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stimframe.llm.common import without, words
from stimframe.session import materialise

#: A source has as many blocks (a power of two) as there are so many tokens in it.
BLOCK_TOKENS = 4096
#: The plan has a row for each source; up to so many rows (some 60 bytes each) are broadcast, more are joined in SALTS parts.
FEW_SOURCES, SALTS = 100_000, 32
#: The last epoch's rows have places of so many bits; where it ends is found DIGIT bits at a time.
PLACE_BITS, DIGIT = 60, 10
#: Exponents tried in one pass over the sources, and passes.
TRIED, PASSES = 64, 7
ADDED = ("n_tokens", "mix_epoch", "mix_block", "mix_at")


@dataclass(frozen=True)
class Share:
    """What the plan says of a source: its tokens, its weight, how often it is gone through, and in how many blocks."""

    source: str
    tokens: int
    weight: float
    repeats: float
    blocks: int


def weights(shares: list[float], exponent: float) -> list[float]:
    """Shares to that power, normalised."""
    logs = [exponent * math.log(s) for s in shares]
    top = max(logs)
    raised = [math.exp(x - top) for x in logs]
    return [x / sum(raised) for x in raised]


def bisect_exponent(shares: list[float], max_repeat: float | None = None, entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target, by bisection.

    With an entropy (bits): the largest exponent whose weights have at least that much. With a repetition limit: the least
    exponent, and so the most even weights, at which no source is gone through more often. budget is in units of all
    tokens; without one it is what lets every source be gone through at least once. 1 keeps the shares as they are.
    A target that no exponent meets is a ValueError: more entropy than even weights have, or a budget that needs more repetition than allowed.
    """

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        return [(sum(s**e for s in shares), sum(s**e * math.log2(s) for s in shares)) for e in exponents]

    return _search(sums, min(shares), max(shares), 1, 60, max_repeat, entropy, budget)


def _search(sums: Callable[[list[float]], list[tuple[float, float]]], least: float, most: float, tried: int, passes: int, max_repeat: float | None, entropy: float | None, budget: float | None) -> float:
    """bisect_exponent() from the sums over sources of s**e and of s**e * log2(s), for `tried` exponents at a time, and the least and largest share."""

    def meets(e: float, z: float, y: float) -> bool:
        if entropy is not None:  # of weights s**e / z
            return math.log2(z) - e * y / z >= entropy - 1e-9
        total = budget if budget is not None else z * most ** (1 - e)  # at which the largest source is gone through once
        return total * least ** (e - 1) / z <= max_repeat * (1 + 1e-12)

    # The end that meets the target sooner, and the end that is wanted.
    easy, hard = (0.0, 1.0) if entropy is not None else (1.0, 0.0)
    (z0, y0), (z1, y1) = sums([easy, hard])
    if meets(hard, z1, y1):
        return hard
    if not meets(easy, z0, y0):
        raise ValueError(f"no weights have an entropy of {entropy} bits" if entropy is not None else f"no weights keep every source under {max_repeat} repetitions")
    for _ in range(passes):
        grid = [easy + (hard - easy) * k / (tried + 1) for k in range(1, tried + 1)]
        good = [e for e, (z, y) in zip(grid, sums(grid)) if meets(e, z, y)]
        step = (hard - easy) / (tried + 1)
        easy = good[-1] if good else easy
        hard = easy + step
    return easy


def plan_mix(totals: dict[str, int], max_repeat: float | None = 2.0, entropy: float | None = None, budget_tokens: float | None = None) -> list[Share]:
    """A Share for each source, from the tokens of each."""
    if not totals:
        return []
    every = sum(totals.values())
    names = sorted(totals)
    shares = [totals[n] / every for n in names]
    w = weights(shares, bisect_exponent(shares, max_repeat, entropy, budget_tokens / every if budget_tokens else None))
    total = budget_tokens or every * max(s / x for s, x in zip(shares, w))
    found = []
    for n, x in zip(names, w):
        repeats = x * total / totals[n]
        repeats = round(repeats) if abs(repeats - round(repeats)) < 1e-9 else repeats
        found.append(Share(n, totals[n], x, repeats, 1 << max(0, math.ceil(math.log2(max(1, totals[n] / BLOCK_TOKENS))))))
    return found


def _turned(seed: int, epoch: Column, block: Column | None = None) -> Column:
    """Place of a block in the permutation of an epoch: an odd factor and a shift, keyed by seed, source and epoch, modulo a power of two."""
    factor = 2 * F.pmod(F.xxhash64(F.lit(seed), "__source", epoch, F.lit(1)), F.lit(1 << 20)) + 1
    shift = F.pmod(F.xxhash64(F.lit(seed), "__source", epoch, F.lit(2)), F.lit(1 << 20))
    return F.pmod((F.col("__block") if block is None else block) * factor + shift, F.col("__blocks"))


def _planned(totals: DataFrame, max_repeat: float | None, entropy: float | None, budget_tokens: float | None) -> DataFrame:
    """plan_mix() over a table (__source, n) of any size: __source, __blocks, __repeats, __whole and __rest."""
    whole = totals.agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    every = float(whole.n)
    share = F.col("n") / F.lit(every)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        aggs = [a for e in exponents for a in (F.sum(F.pow(share, F.lit(e))), F.sum(F.pow(share, F.lit(e)) * F.log2(share)))]
        row = totals.agg(*aggs).first()
        return list(zip(row[::2], row[1::2]))

    e = _search(sums, whole.least / every, whole.most / every, TRIED, PASSES, max_repeat, entropy, budget_tokens / every if budget_tokens else None)
    z = sums([e])[0][0]
    total = budget_tokens or every * z * (whole.most / every) ** (1 - e)
    repeats = F.pow(share, F.lit(e - 1)) * F.lit(total / z / every)
    near = F.round(repeats)
    return (
        totals.withColumn("__repeats", F.when(F.abs(repeats - near) < 1e-9, near).otherwise(repeats))
        .withColumn("__blocks", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / BLOCK_TOKENS)))).cast("long"))
        .withColumn("__whole", F.floor("__repeats").cast("int"))
        .select("__source", "__blocks", "__repeats", "__whole", ((F.col("__repeats") - F.col("__whole")) * F.col("n")).alias("__rest"))
    )


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows (with __source and __k) joined with the plan's columns; a source with most rows is spread over tasks either way."""
    if few:
        return rows.join(F.broadcast(plan), "__source")
    salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod("__k", F.lit(SALTS)).cast("int")).join(salted, ["__source", "__salt"]).drop("__salt")


def _place(seed: int) -> Column:
    """Place of a row in the last epoch, from 0 to 2**PLACE_BITS: that of its block, then a hash of its key."""
    size = F.expr(f"{1 << PLACE_BITS}L div __blocks")
    return _turned(seed, F.col("__whole"), F.pmod("__k", F.col("__blocks"))) * size + F.pmod(F.xxhash64("__k", F.lit(7)), size)


def _cuts(small: DataFrame, plan: DataFrame, few: bool, seed: int) -> DataFrame:
    """Where each source's last, partial epoch ends: rows with places under __cut are in it, and __tied of the rows at __cut.

    The tokens of 2**DIGIT ranges of places are summed; the range in which the budget ends is divided further, until it holds
    one row. Only the rows of such ranges go on, and a source never has more than 2**DIGIT sums in a task.
    """
    live = _with_plan(small, plan.where("__rest > 0"), few).withColumn("__place", _place(seed)).select("__source", "__place", "n_tokens")
    state = plan.where("__rest > 0").select("__source", F.lit(0).cast("long").alias("__cut"), F.col("__rest").alias("__left"))
    turn = Window.partitionBy("__source").orderBy("__digit")
    done: list[DataFrame] = []
    for level in range(1, PLACE_BITS // DIGIT + 1):
        shift = PLACE_BITS - level * DIGIT
        digit = F.shiftright("__place", shift).alias("__digit")  # all digits so far
        sums = live.groupBy("__source", digit).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("n_tokens").alias("least")).withColumn("__sum", F.sum("n").over(turn))
        over = sums.join(state.select("__source", "__left"), "__source").where("__sum > __left").groupBy("__source").agg(F.min_by(F.struct("__digit", (F.col("__left") - F.col("__sum") + F.col("n")).alias("left"), "rows", "least"), "__digit").alias("c"))
        found = state.join(over, "__source", "left").select(
            "__source", F.when(F.col("c").isNull(), F.lit(1 << PLACE_BITS)).otherwise(F.shiftleft("c.__digit", shift)).alias("__cut"),
            F.coalesce("c.left", F.lit(0.0)).alias("__left"), F.coalesce("c.rows", F.lit(0)).alias("rows"), F.coalesce("c.least", F.lit(1)).alias("least"),
        )
        found = materialise(found, "mix-cuts")
        last = level == PLACE_BITS // DIGIT
        done.append(found.where("rows < 2" if not last else "true").select("__source", "__cut", F.floor(F.when(F.col("rows") > 1, F.col("__left") / F.col("least")).otherwise(0)).cast("int").alias("__tied")))
        state = found.where("rows > 1").select("__source", "__cut", "__left")
        if last or state.isEmpty():
            break
        live = materialise(live.join(F.broadcast(state.select("__source", "__cut")) if few else state.select("__source", "__cut"), "__source").where(F.shiftright("__place", shift) == F.shiftright("__cut", shift)).drop("__cut"), "mix-live")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix_sources(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", max_repeat: float | None = 2.0, entropy: float | None = None, budget_tokens: float | None = None, seed: int = 20, carry: list[str] | None = None) -> DataFrame:
    """The rows of docs in the mix, each as often as it comes up, with n_tokens, mix_epoch, mix_block and mix_at.

    A token is a word, an empty text counts as one. The shares of the sources are raised to the exponent that meets the target
    (see bisect_exponent; a target that can't be met is a ValueError) and normalised. A source goes through its rows `repeats`
    times: rows are dealt to blocks of about BLOCK_TOKENS tokens by a keyed hash, each epoch permutes the blocks by its own key, and
    the last epoch ends where the budget does: whole blocks, then the rows of one block in the order of a hash while they fit.
    mix_at, from 0 to 1, is the place of a row in its source's run: rows in its order show the weights all along.

    Sums by source and by ranges of places are shuffled, and keys of the rows where an epoch ends; rows themselves only if there
    are more than FEW_SOURCES sources. The driver gets sums over all sources alone. Without a budget every row comes up at
    least once. A null source counts as the empty name; null ids and repeated rows are rows like others; an empty table gives
    an empty result; columns with an added name are replaced.
    """
    rows = without(docs, [*ADDED, "__source", "__k", "__blocks", "__block", "__repeats", "__whole", "__rest", "__cut", "__tied", "__place", "__nth", "__salt"])
    names = carry or rows.columns
    keyed = (
        rows.withColumn("__source", F.coalesce(F.col(source_col), F.lit("")))
        .withColumn("n_tokens", F.greatest(F.size(words(F.col(text_col))), F.lit(1)).cast("long"))
        .withColumn("__k", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    )
    small = materialise(keyed.select("__source", "__k", "n_tokens"), "mix")
    totals = materialise(small.groupBy("__source").agg(F.sum("n_tokens").alias("n")), "mix-totals")
    sources = totals.count()
    if not sources:
        none = keyed.select(*[F.col(f"`{n}`") for n in names], "n_tokens", F.lit(0).alias("mix_epoch"), F.lit(0).cast("long").alias("mix_block"), F.lit(0.0).alias("mix_at"))
        return none.where("false")
    few = sources <= FEW_SOURCES
    plan = materialise(_planned(totals, max_repeat, entropy, budget_tokens), "mix-plan")
    ends = _cuts(small, plan, few, seed)
    plan = materialise(plan.join(ends, "__source", "left").withColumns({"__cut": F.coalesce("__cut", F.lit(0).cast("long")), "__tied": F.coalesce("__tied", F.lit(0))}), "mix-ends")
    dealt = (
        _with_plan(keyed.select(*[F.col(f"`{n}`") for n in names], "__source", "n_tokens", "__k"), plan, few)
        .withColumn("__block", F.pmod("__k", F.col("__blocks"))).withColumn("__place", _place(seed))
    )
    epochs = F.col("__whole") + F.when(F.col("__place") < F.col("__cut"), 1).otherwise(0)
    whole = dealt.where(epochs > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    # Rows of one source with one place: those of equal id and text.
    nth = F.row_number().over(Window.partitionBy("__source").orderBy("__k"))
    some = dealt.where((F.col("__tied") > 0) & (F.col("__place") == F.col("__cut"))).withColumn("__nth", nth).where("__nth <= __tied").drop("__nth").withColumn("mix_epoch", F.col("__whole"))
    spread = F.pmod(F.shiftright("__k", 20), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (
        whole.unionByName(some)
        .withColumn("mix_block", _turned(seed, F.col("mix_epoch")))
        .withColumn("mix_at", F.least(F.lit(1.0), (F.col("mix_epoch") + (F.col("mix_block") + spread) / F.col("__blocks")) / F.col("__repeats")))
        .select(*[f"`{n}`" for n in names], *ADDED)
    )
