"""Personal data: fixed patterns, and candidate spans that boosted trees select."""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimframe.llm.common import without
from stimframe.llm.spans import as_text, find_spans, overlaps
from stimframe.session import materialise

_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_LUHN = f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + case when i % 2 = 1 then int(substring({_DIGITS}, -i, 1)) else int(substring({_DIGITS}, -i, 1)) * 2 - if(int(substring({_DIGITS}, -i, 1)) > 4, 9, 0) end) % 10 = 0"
#: The patterns of the contract and the condition on a match {m}. They are written so that Java neither recurses nor
#: starts again within a run that has failed: \G with a look-behind admits the same matches as the plain pattern.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 and int(right(p, 3)) <= 255)"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, f"length({_DIGITS}) between 13 and 19 and {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", f"length({_DIGITS}) between 9 and 15"),
}
#: Generators of candidates: wide patterns whose spans may overlap each other and the base spans.
GENERATORS = {
    "wide_email": (r"(?:\G|(?<![^\s@\[\(]))[^\s@\[\(]++\s?(?:@|\(at\)|\[at\])\s?[^\s@]++(?:\s?(?:\(dot\)|\[dot\])\s?[^\s@]++)*+", None),
    "wide_number": (r"(?:\G|(?<![0-9A-Za-z]))\+?\(?[0-9](?:[\x20()./-]*+[0-9]){6,}+", None),
    "narrow_number": (r"(?:\G|(?<![0-9]))[0-9]{7,}+", None),
    "wide_dotted": (r"(?:\G|(?<![0-9.]))[0-9]++(?:(?:[.,]|\[\.\])[0-9]++){2,}+", None),
}
#: Other ways to write a base span m with digits d, by its kind, as SQL; each is what its pattern doesn't match or refuses.
VARIANTS = {
    "email": ("replace(m, '@', ' (at) ')", "replace(m, '@', '[at]')", "replace(m, '@', ' @ ')", "concat(substring_index(m, '@', 1), '(at)', replace(substring_index(m, '@', -1), '.', ' (dot) '))"),
    "ip": ("replace(m, '.', '[.]')", "replace(m, '.', ',')", "regexp_replace(m, '[.]([0-9]+)$', '[.]$1')"),
    "card": (
        "concat_ws('.', substring(d, 1, 4), substring(d, 5, 4), substring(d, 9, 4), substring(d, 13))", "concat_ws('/', substring(d, 1, 4), substring(d, 5, 4), substring(d, 9, 4), substring(d, 13))",
        "concat(d, ' ', d)",
    ),
    "phone": ("concat('(', substring(d, -10, 3), ') ', substring(d, -7, 3), '-', right(d, 4))", "concat_ws('-', substring(d, -10, 3), substring(d, -7, 3), right(d, 4))", "concat_ws('.', substring(d, -10, 3), substring(d, -7, 3), right(d, 4))", "concat('00', d)", "concat('00', substring(d, 1, 2), ' ', substring(d, 3, 2), ' ', substring(d, 5, 4), ' ', substring(d, 9))"),
}
#: Words that stand before such data, by kind, and before numbers that look like it.
CUES = {"email": ("mail", "contact", "e-mail"), "ip": ("host", "ip", "server"), "card": ("card", "visa", "credit card"), "phone": ("call", "phone", "tel", "fax")}
OTHER_CUES = ("invoice", "order", "part", "ref", "serial", "version", "isbn", "section")
#: What looks like them and isn't personal: dates, times, amounts, versions, books, numbers of other lengths or beginnings, handles; drawn by the hash {k}.
_N = "pmod(shiftright({k}, %d), %dL)"
_LONG = "lpad(cast(abs(xxhash64({k}, %d)) as string), 19, '7')"
DECOYS = (
    f"format_string('%04d-%02d-%02d %02d:%02d', 1950 + {_N % (3, 90)}, 1 + {_N % (9, 12)}, 1 + {_N % (13, 28)}, {_N % (17, 24)}, {_N % (21, 60)})",
    f"format_string('%02d.%02d.%04d', 1 + {_N % (9, 28)}, 1 + {_N % (13, 12)}, 1950 + {_N % (3, 90)})",
    f"format_string('%d,%03d,%03d.%02d', 1 + {_N % (9, 900)}, {_N % (13, 1000)}, {_N % (23, 1000)}, {_N % (31, 100)})",
    f"format_string('%d.%d.%d', {_N % (9, 20)}, {_N % (13, 40)}, {_N % (23, 4000)})",
    f"format_string('%d.%d.%d.%d', {_N % (9, 20)}, {_N % (13, 40)}, {_N % (23, 20)}, 256 + {_N % (29, 9000)})",
    f"format_string('97%d-%d-%04d-%04d-%d', 8 + {_N % (9, 2)}, {_N % (13, 10)}, {_N % (17, 10000)}, {_N % (31, 10000)}, {_N % (44, 10)})",
    f"concat(1 + {_N % (7, 2)}, left({_LONG % 1}, 6 + {_N % (9, 3)}))",
    f"concat(element_at(array('0', '1', '7', '8', '9'), cast(1 + {_N % (7, 5)} as int)), left({_LONG % 2}, 12 + {_N % (9, 6)}))",
    f"left({_LONG % 5}, 13 + {_N % (9, 7)})",
    f"concat('00', left({_LONG % 6}, 14 + {_N % (9, 4)}))",
    f"concat({_LONG % 3}, left({_LONG % 4}, 2 + {_N % (9, 17)}))",
    f"format_string('%02d:%02d.%d.%03d', {_N % (9, 24)}, {_N % (13, 60)}, {_N % (17, 60)}, {_N % (31, 1000)})",
    f"concat('x', {_N % (9, 900)}, '@', 1 + {_N % (13, 3)}, 'x')",
    f"concat('@user', {_N % (9, 9000)}, ' @ noon,')",
    f"format_string('%d.%s', {_N % (9, 30)}, left({_LONG % 7}, 8 + {_N % (13, 8)}))",
    f"format_string('%d-%d-%d', 1900 + {_N % (9, 130)}, 1900 + {_N % (17, 130)}, 1900 + {_N % (25, 130)})",
    f"format_string('%d.%04d %d.%04d %d', {_N % (9, 90)}, {_N % (16, 10000)}, {_N % (30, 180)}, {_N % (38, 10000)}, {_N % (52, 20)})",
    f"format_string('%02d/%02d/%04d %02d/%02d/%04d', 1 + {_N % (9, 28)}, 1 + {_N % (14, 12)}, 1950 + {_N % (18, 90)}, 1 + {_N % (25, 28)}, 1 + {_N % (30, 12)}, 1950 + {_N % (34, 90)})",
    f"format_string('%05d-%s', {_N % (9, 100000)}, left({_LONG % 8}, 5 + {_N % (27, 4)}))",
    f"format_string('%d-%d/%d-%d', {_N % (9, 900)}, {_N % (20, 900)}, {_N % (30, 9000)}, {_N % (44, 90)})",
)
#: Features of a candidate: of its format, and of the 24 characters on either side. The library counts every value of a feature, so the largest part ends at 256, where addresses do.
FEATURES = {
    "length": "length(c.m)",
    "digits": "length(regexp_replace(c.m, '[^0-9]', ''))",
    "letters": "length(regexp_replace(c.m, '[^A-Za-z]', ''))",
    "dots": "length(c.m) - length(replace(c.m, '.', ''))",
    "spaces": "length(c.m) - length(replace(c.m, ' ', ''))",
    "dashes": "length(c.m) - length(replace(c.m, '-', ''))",
    "brackets": "length(c.m) - length(regexp_replace(c.m, '[()]', ''))",
    "plus": "int(c.m like '+%')",
    "zeros": "int(c.m like '00%')",
    "at": "int(contains(c.m, '@'))",
    "spelled_at": "int(contains(c.m, '(at)') or contains(c.m, '[at]'))",
    "ends_dotted": "int(c.m rlike '[A-Za-z0-9](?:[.]| ?[(]dot[)] ?| ?\\\\[dot\\\\] ?)[A-Za-z]{2,}[.,;]?$')",
    "slashes": "length(c.m) - length(replace(c.m, '/', ''))",
    "commas": "length(c.m) - length(replace(c.m, ',', ''))",
    "square": "length(c.m) - length(replace(c.m, '[', ''))",
    "groups": "size(split(trim(regexp_replace(c.m, '[^0-9]+', ' ')), ' '))",
    "longest_group": "array_max(transform(split(c.m, '[^0-9]+'), g -> length(g)))",
    "first_digit": "coalesce(try_cast(regexp_extract(c.m, '[0-9]', 0) as int), -1)",
    "largest_part": "coalesce(array_max(transform(split(c.m, '[^0-9]+'), g -> least(try_cast(g as double), 256D))), -1D)",
    "luhn": "int(length(c.digits) between 1 and 19 and aggregate(sequence(1, least(greatest(length(c.digits), 1), 19)), 0, (a, i) -> a + coalesce(case when i % 2 = 1 then int(substring(c.digits, -i, 1)) else int(substring(c.digits, -i, 1)) * 2 - if(int(substring(c.digits, -i, 1)) > 4, 9, 0) end, 0)) % 10 = 0)",
    "space_before": "int(c.before = '' or c.before rlike '[\\\\s(<]$')",
    "letter_before": "int(c.before rlike '[A-Za-z_=]$')",
    "letter_after": "int(c.after rlike '^[A-Za-z_=]')",
    "says_phone": "int(lower(c.before) rlike 'phone|tel|call|fax|mobil')",
    "says_card": "int(lower(c.before) rlike 'card|visa|credit')",
    "says_mail": "int(lower(c.before) rlike 'mail|contact')",
    "says_address": "int(lower(c.before) rlike 'ip|host|addr|server')",
    "says_version": "int(lower(c.before) rlike 'version|release|v$|isbn|section')",
    "says_other": "int(lower(c.before) rlike 'invoice|order|part|ref|serial|sku|page|article')",
    "years": "size(filter(split(c.m, '[^0-9]+'), g -> length(g) = 4 and (g like '19%' or g like '20%')))",
    "small_groups": "size(filter(split(c.m, '[^0-9]+'), g -> length(g) between 1 and 2))",
}
ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base", "candidates", "added")


def find_candidates(docs: DataFrame, text_col: str = "text", id_cols: list[str] | None = None) -> DataFrame:
    """id_cols of docs with the counts, base spans by kind and start, and candidates with their features x.

    A candidate also has the 24 characters on either side, and in `of` the kind of a base span that overlaps it (null if none
    does). Null text counts as empty, an empty table gives an empty result, repeated rows and ties get equal results, columns
    with an added name are replaced.
    """
    df = without(docs, [*ADDED, "__t"]).withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    names = id_cols or df.columns[:-1]
    for kind, (pattern, hint, keep) in PATTERNS.items():
        df = find_spans(df, "__t", kind, pattern, f"__s_{kind}", hint, keep)
    for kind, (pattern, hint) in GENERATORS.items():
        df = find_spans(df, "__t", kind, pattern, f"__g_{kind}", hint)
    x = ", ".join(f"double({e})" for e in FEATURES.values())
    return (
        df.withColumns({f"n_{k}": F.size(f"__s_{k}").cast("long") for k in PATTERNS})
        .withColumn("base", F.expr(f"concat({', '.join(f'__s_{k}' for k in PATTERNS)})"))
        .withColumn("__c", F.expr(f"transform(concat({', '.join(f'__g_{k}' for k in GENERATORS)}), s -> struct(s.kind, s.start, s.stop, s.m, regexp_replace(s.m, '[^0-9]', '') as digits, substring(__t, greatest(s.start - 23, 1), least(s.start, 24)) as before, substring(__t, s.stop + 1, 24) as after))"))
        .withColumn("candidates", F.expr(f"transform(__c, c -> struct(c.kind, c.start, c.stop, c.m, c.before, c.after, array({x}) as x, case {' '.join(f"when {overlaps(f'__s_{k}', 'c')} then '{k}'" for k in PATTERNS)} end as of))"))
        .select(*[f"`{n}`" for n in names], *[f"n_{k}" for k in PATTERNS], "base", "candidates")
    )


#: Templates are dealt to so many parts; each part is scored by trees that saw no template of it.
PARTS = 2


def exercises(found: DataFrame) -> DataFrame:
    """Labelled texts made from the corpus: text, start, stop (of what was put in), kind, template, y and held: one span in five, with all that is made of it or in its place.

    Each candidate that a base span overlaps is written in the ways of VARIANTS that its pattern doesn't match (y 1)
    between its own surroundings, half of them behind a word of CUES. Decoys (y 0) stand in surroundings of their own, those of
    every candidate that no base span overlaps, and one in the place of each that one does; half of them behind a word of OTHER_CUES or, less often, of CUES. And
    a variant of each number behind a word of OTHER_CUES is a decoy as well: there the surroundings alone tell; so is a card's with a wrong last digit, behind the same words as
    a right one: there the digits alone tell. The base patterns take no part in the labels. No candidate is left out but those of
    100 characters or more, which hold more than one span and so have no label; they are scored like the others.
    """
    every = found.select(F.explode("candidates").alias("c")).where("length(c.m) < 100").select("c.of", "c.m", "c.before", "c.after", F.xxhash64("c.m", "c.start").alias("h"))
    every = every.withColumn("d", F.expr("regexp_replace(m, '[^0-9]', '')"))
    forms = [(of, f"{of}-{k}", e) for of, own in VARIANTS.items() for k, e in enumerate(own)]
    cue = lambda words, k: f"case when pmod(shiftright(h, {k}), 2L) = 0 then '' else concat(' ', element_at(array({', '.join(map(repr, words))}), cast(1 + pmod(shiftright(h, {k + 1}), {len(words)}L) as int))) end"
    made = [f"struct('{of}' as kind, '{name}' as template, {e} as made, {cue(CUES[of], 31 + k)} as cue, 1D as y)" for k, (of, name, e) in enumerate(forms)]
    turned = [f"struct('{of}' as kind, 'turned-{name}' as template, {e} as made, concat(' ', element_at(array({', '.join(map(repr, OTHER_CUES))}), cast(1 + pmod(shiftright(h, 13), {len(OTHER_CUES)}L) as int))) as cue, 0D as y)" for of, name, e in forms if of in ("phone", "card") and name != "card-2"]
    wrong = [f"struct('card' as kind, 'wrong-{name}' as template, transform(array(concat(left(d, length(d) - 1), (coalesce(try_cast(right(d, 1) as int), 0) + 1) % 10)), d -> {e})[0] as made, {cue(CUES['card'], 37)} as cue, 0D as y)" for name, e in (("card", "d"), *((n, e) for of, n, e in forms if of == "card"))]
    decoy = f"array(struct('decoy' as kind, concat('decoy-', pmod(k, {len(DECOYS)}L)) as template, {_one_of([e.format(k='k') for e in DECOYS], 'k')} as made, {cue((*OTHER_CUES, *OTHER_CUES, *[w for own in CUES.values() for w in own]), 29)} as cue, 0D as y))"
    decoy = lambda key, inner=decoy: f"flatten(transform(array({key}), k -> {inner}))"
    # Of two numbers in a row the second doesn't see the word before the first: no turned variant. One of the others for each span, so that they are about as many as a variant, and two with a wrong digit.
    some_of = lambda forms, shift, n, take: f"slice(filter(array({', '.join(forms)}), v -> v.kind = of), cast(1 + pmod(shiftright(h, {shift}), {n}L) as int), {take})"
    picked = f"concat(filter(array({', '.join(made)}), v -> v.kind = of), {decoy('h')}, {some_of(turned, 17, 3, 1)}, {some_of(wrong, 19, 3, 2)})"
    rows = every.where("of is not null").withColumn("made", F.explode(F.expr(picked)))
    rows = rows.unionByName(every.where("of is null").withColumn("made", F.explode(F.expr(decoy("xxhash64(h)")))))
    lead = F.length("before") + F.length("made.cue") + 1
    return rows.where("made.made is not null and made.made <> m").select(
        F.concat("before", "made.cue", F.lit(" "), "made.made", F.lit(" "), "after").alias("text"),
        lead.alias("start"), (lead + F.length("made.made")).alias("stop"), "made.kind", "made.template", "made.y", (F.pmod(F.shiftright("h", 24), F.lit(5)) == 0).alias("held"),
    )


def _one_of(choices: list[str], key: str) -> str:
    return f"case pmod({key}, {len(choices)}L) " + " ".join(f"when {i} then {e}" for i, e in enumerate(choices)) + " end"


def practised(found: DataFrame) -> DataFrame:
    """Candidates in the texts of exercises() that lie in what was put in and that no base span overlaps: kind, of (the variant's), template, part, m, x, y and held."""
    # Written first, and with an outer explode: else the patterns' expressions are planned for both parts of the union and once more in a filter on the array's size.
    made = materialise(exercises(found), "pii-exercises").withColumnsRenamed({"kind": "__of", "start": "__a", "stop": "__b"})
    inner = find_candidates(made, "text", ["__of", "__a", "__b", "template", "y", "held"]).select("__of", "__a", "__b", "template", "y", "held", F.explode_outer("candidates").alias("c"))
    part = F.pmod(F.xxhash64("template", F.lit(3)), F.lit(PARTS)).alias("part")
    return inner.where("c.of is null and c.start >= __a and c.stop <= __b").select("c.kind", F.col("__of").alias("of"), "template", part, "c.m", "c.x", "y", "held")


def _bins(rows: int) -> int:
    """maxBins with which the library takes the places where trees may split from all rows: it draws max(10000, maxBins ** 2) of them, in 32 bits."""
    return 32 if rows <= 10_000 else min(math.isqrt(rows) + 1, 46_340)


def _trees(rows: DataFrame, trees: int, depth: int) -> GBTClassificationModel | None:
    fit = rows.select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    labels, n = fit.agg(F.count_distinct("label"), F.count(F.lit(1))).first()
    return GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=_bins(n), seed=7).fit(fit) if labels == 2 else None


def unseen(tried: DataFrame, trees: int = 20, depth: int = 4) -> DataFrame:
    """The rows of practised() with p: what trees that saw none of a row's part of the templates make of it. It tells how the trees do on ways of writing that nobody listed."""
    out = None
    for k in range(PARTS):
        model = _trees(tried.where(F.col("part") != k), trees, depth)
        if model is None:
            return tried.where("false").withColumn("p", F.lit(0.0))
        rows = tried.where(F.col("part") == k).withColumn("p", score(model, "x"))
        out = rows if out is None else out.unionByName(rows)
    return out


def fit_trees(found: DataFrame, trees: int = 20, depth: int = 4, precision: float = 0.98) -> tuple[GBTClassificationModel | None, dict[str, float]]:
    """Boosted trees, and for each generator the score from which its candidates are selected.

    They are fitted on all candidates of practised() but for the held-out fifth, and split where all of them say. The threshold is for
    each generator the lowest of fifty from 0.5 up at which this part shows the precision, decoys weighted to the share that
    candidates without a base span have among the generator's candidates in the corpus. A generator without one
    selects nothing, and so does everything if the corpus has no base spans.
    """
    tried = materialise(practised(found), "pii-practised")
    model = _trees(tried.where("not held"), trees, depth)
    if model is None:
        return None, {}
    corpus = {r.kind: (r.known, r.n - r.known) for r in found.select(F.explode("candidates").alias("c")).groupBy("c.kind").agg(F.count("c.of").alias("known"), F.count(F.lit(1)).alias("n")).collect()}
    bins = tried.where("held").withColumn("p", score(model, "x")).groupBy("kind", F.floor(F.col("p") * 100).cast("int").alias("bin")).agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    limits = {}
    for kind in GENERATORS:
        own = [b for b in bins if b.kind == kind]
        good, bad = sum(b.good for b in own), sum(b.n - b.good for b in own)
        known, other = corpus.get(kind, (0, 0))
        # What a decoy weighs against a variant, so that both are as frequent as in the corpus.
        weight = max(1.0, (other / bad) / (known / good)) if good and bad and known else 1.0
        for t in range(50, 100):
            above = [b for b in own if b.bin >= t]
            hits, wrong = sum(b.good for b in above), sum(b.n - b.good for b in above)
            if hits and hits >= precision * (hits + weight * wrong):
                limits[kind] = t / 100
                break
    return model, limits


def score(model: GBTClassificationModel, x: str):
    """The model's probability as a SQL expression over an array of features."""
    total = " + ".join(f"({w!r}D * {_branches(t.toDebugString, x)})" for t, w in zip(model.trees, model.treeWeights))
    return F.expr(f"1D / (1D + exp(-2D * ({total})))")


def _branches(shown: str, x: str) -> str:
    """CASE expressions from the lines in which the library prints a tree: If, Else and Predict."""
    lines = [line.strip() for line in shown.splitlines()[1:] if line.strip()]

    def node(i: int) -> tuple[str, int]:
        if m := re.match(r"Predict: (\S+)", lines[i]):
            return f"({m[1]}D)", i + 1
        feature, at = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i]).groups()
        low, i = node(i + 1)
        high, i = node(i + 1)
        return f"(case when {x}[{feature}] <= {at}D then {low} else {high} end)", i

    return node(0)[0]


def find_pii(docs: DataFrame, text_col: str = "text", id_cols: list[str] | None = None, trees: int = 20) -> DataFrame:
    """id_cols of docs (all columns if not given) with n_email, n_ip, n_card, n_phone (long), and base and added: arrays of struct(kind, start, stop, m).

    base has the matches of PATTERNS that pass their checks, by kind, then start. added has the candidates that the trees
    score at or above their generator's threshold and that no base span overlaps, of candidates that overlap each other the best: addresses and numbers in other ways of
    writing, and numbers that stand beside others. Texts are read once; what follows works
    on the spans, written to the shared folder. Null text counts as empty; an empty table gives an empty result; repeated
    rows get equal results; columns with an added name are replaced.
    """
    found = materialise(find_candidates(docs, text_col, id_cols), "pii")
    model, limits = fit_trees(found, trees)
    if not limits:
        return found.withColumn("added", F.expr("transform(filter(candidates, c -> false), c -> struct(c.kind, c.start, c.stop, c.m))")).drop("candidates")
    at = "case c.kind " + " ".join(f"when '{k}' then {v!r}D" for k, v in limits.items()) + " else 2D end"
    total = " + ".join(["0D", *[f"({w!r}D * {_branches(t.toDebugString, 'c.x')})" for t, w in zip(model.trees, model.treeWeights)]])
    scored = f"transform(filter(candidates, c -> c.of is null), c -> struct(c.start, c.stop, c.kind, c.m, 1D / (1D + exp(-2D * ({total}))) as p, {at} as least))"
    ordered = f"array_sort(filter({scored}, c -> c.p >= c.least))"
    # From left to right: of spans that overlap the best stays; among equals the longer one, then the first.
    better = "struct(s.p, s.stop - s.start) > struct(st.last.p, st.last.stop - st.last.start)"
    keep = "if(st.last is null, st.done, array_append(st.done, st.last))"
    kind = "array<struct<start:int,stop:int,kind:string,m:string,p:double,least:double>>"
    best = f"aggregate({ordered}, struct(cast(array() as {kind}) as done, cast(null as {kind[6:-1]}) as last), (st, s) -> case when st.last is null or s.start >= st.last.stop then struct({keep} as done, s as last) when {better} then struct(st.done as done, s as last) else st end, st -> {keep})"
    return found.withColumn("added", F.expr(f"transform({best}, c -> struct(c.kind, c.start, c.stop, c.m))")).drop("candidates")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """docs with each span of the text, base or added, replaced by its kind; of overlapping spans the first stands for both.

    A null text stays null; an empty table gives an empty result; repeated rows get equal results; columns named as those that
    find_pii() adds stay as they are.
    """
    aside = {c: f"__own_{c}" for c in docs.columns if c.lower() in ADDED}
    docs = docs.withColumnsRenamed(aside)
    found = find_pii(docs, text_col)
    spans = "array_sort(concat(base, added), (a, b) -> case when struct(a.start, -a.stop) < struct(b.start, -b.stop) then -1 when struct(a.start, -a.stop) > struct(b.start, -b.stop) then 1 else 0 end)"
    cut = f"aggregate({spans}, struct('' as done, 0 as at), (st, s) -> case when s.start < st.at then struct(st.done, greatest(st.at, s.stop) as at) else struct(concat(st.done, substring(`{text_col}`, st.at + 1, s.start - st.at), '{mark.format('')[:1]}', s.kind, '{mark.format('')[-1:]}') as done, s.stop as at) end, st -> concat(st.done, substring(`{text_col}`, st.at + 1)))"
    done = found.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.expr(cut))).drop(*ADDED)
    return done.withColumnsRenamed({v: k for k, v in aside.items()})


def digest(found: DataFrame) -> DataFrame:
    """found with base_sha256 and spans."""
    every = "array_sort(added, (a, b) -> case when struct(a.kind, a.start) < struct(b.kind, b.start) then -1 when struct(a.kind, a.start) > struct(b.kind, b.start) then 1 else 0 end)"
    return found.withColumn("base_sha256", F.sha2(F.expr(as_text("base")).cast("binary"), 256)).withColumn("spans", F.expr(as_text(f"concat(base, {every})")))
