"""Quality rules: counts within each text, and the frequency of lines across the documents of a host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimframe.llm.common import SPACE, fenced, without, words
from stimframe.session import materialise

#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_lines", "base_failed", "depleted", "kept")
_OWN = ("__t", "__w", "__b", "__lines", "__tri", "__same", "__pos", "__host", "__content", "__hit", "__dry", "__fewer", "__salt")
#: A line is counted in so many parts, so that one that is in every document doesn't meet in one task.
SALTS = 32


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; each row by itself, with no shuffle.

    For n_repeat_words, each three-word window is packed as one long, its hash above its position, so that a sort of longs
    puts equal windows side by side; the words themselves are compared wherever two hashes meet. Should they differ, the
    windows of that text are sorted by their words instead. The positions of windows
    found twice, in order, cover min(3, distance to the next) words each.

    A null text counts as empty, with zeros; repeated rows have equal counts; an empty table gives an empty result; columns of docs with an added name must be set aside first, as quality_rules() does.
    """
    counted = (
        docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
        .withColumn("__w", words(F.col("__t")))
        .withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("__b", F.length(F.bin("n_words")))
        .withColumn("__tri", F.expr("sort_array(transform(slice(__w, 1, cast(greatest(n_words - 2, 0) as int)), (x, i) -> shiftleft(xxhash64(x, get(__w, i + 1), get(__w, i + 2)), __b) | cast(i as bigint)))"))
        .withColumn("__same", F.expr(f"transform(__tri, (x, i) -> case when i = 0 or shiftrightunsigned(x, __b) <> shiftrightunsigned(get(__tri, i - 1), __b) then 0 when {_same_words('get(__tri, i - 1)')} then 1 else 2 end)"))
        .withColumn("__pos", F.expr(f"sort_array(case when array_contains(__same, 2) then {_BY_WORDS} else transform(filter(__tri, (x, i) -> get(__same, i) = 1 or coalesce(get(__same, i + 1) = 1, false)), x -> cast(x & (shiftleft(1L, __b) - 1) as int)) end)"))
        .withColumn("n_repeat_words", F.expr("aggregate(transform(__pos, (p, i) -> least(3, coalesce(get(__pos, i + 1) - p, 3))), 0L, (a, x) -> a + x)"))
        .withColumn("word_chars", F.length(F.translate("__t", SPACE, "")).cast("long"))
        .withColumn("n_symbols", (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long"))
        .withColumn("__lines", F.filter(F.split("__t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .drop("__t", "__w", "__b", "__tri", "__same", "__pos", "__lines")
    )
    return fenced(counted, ADDED[:5])


def _same_words(y: str) -> str:
    """Whether the windows x and y of a text have the same words."""
    mask = "(shiftleft(1L, __b) - 1)"
    return " and ".join(f"get(__w, cast(x & {mask} as int) + {k}) = get(__w, cast({y} & {mask} as int) + {k})" for k in range(3))


#: Positions of the windows found twice, from the words themselves; words hold no blank.
_BY_WORDS = (
    "transform(array(sort_array(transform(slice(__w, 1, cast(greatest(n_words - 2, 0) as int)), (x, i) -> struct(concat_ws(' ', x, get(__w, i + 1), get(__w, i + 2)) as t, i as i)))),"
    " z -> transform(filter(z, (s, i) -> coalesce(s.t = get(z, i - 1).t, false) or coalesce(s.t = get(z, i + 1).t, false)), s -> s.i))[0]"
)


def _content(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """Host, and a hash of the text: copies of a text on one host are one document."""
    return docs.withColumn("__host", F.coalesce(F.col(host_col), F.lit(""))).withColumn("__content", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def _normal(line):
    return F.lower(F.btrim(line, F.lit(SPACE)))


def _n_words(line):
    """How many words a line has, without a pattern."""
    return F.size(F.array_remove(F.split(F.translate(line, SPACE, " " * len(SPACE)), " "), ""))


def frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", at_least: int = 5, share: float = 0.01) -> DataFrame:
    """The lines of each document (a host's distinct text) that stand in more of its host's documents than the limit.

    A line is hashed in lower case without outer white space. The limit is the larger of `at_least` documents and
    `share` of the host's documents. Returns __host, __content, line (hash), chars and words (of the line), total (characters of
    all distinct lines of the document). Texts are cut into lines once, and the lines are written; the first exchange deals by (host,
    line, document), so no line and no host makes a large group; counts are summed partly before they move, and lines meet their
    counts in SALTS parts, if those counts are too many to broadcast.

    Null and empty texts have no lines; a null host shares one with the empty name; copies of a text on one host and lines
    repeated in a text count once; an empty table gives an empty result.
    """
    rows = _content(docs, text_col, host_col)
    lines = (
        rows.select("__host", "__content", F.array_distinct(F.filter(F.transform(F.split(F.col(text_col), "\n", -1), _normal), lambda x: x != "")).alias("__lines"))
        .withColumn("total", F.aggregate("__lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))
        .select("__host", "__content", "total", F.explode("__lines").alias("__line"))
        .groupBy("__host", F.xxhash64("__line").alias("line"), "__content")
        .agg(F.max(F.length("__line")).alias("chars"), F.max(_n_words(F.col("__line"))).alias("words"), F.max("total").alias("total"))
    )
    lines = materialise(lines, "lines")
    hosts = rows.select("__host", "__content").distinct().groupBy("__host").agg(F.count(F.lit(1)).alias("__docs"))
    often = (
        lines.groupBy("__host", "line").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > at_least)
        .join(hosts, "__host").where(F.col("__n") > share * F.col("__docs")).select("__host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    )
    often = materialise(often, "often")  # its size is then known: Spark broadcasts it only if that is small
    return lines.withColumn("__salt", F.pmod("__content", F.lit(SALTS)).cast("int")).join(often, ["__host", "line", "__salt"]).drop("__salt")


def _hits(lines: DataFrame, min_left: float, listed: bool) -> DataFrame:
    """Of each document with frequent lines: how many, their words, whether too little of its text is left without them, and (listed) which."""
    found = [F.count(F.lit(1)).alias("n_frequent_lines"), F.sum("words").alias("__fewer"), (F.max("total") - F.sum("chars") < min_left * F.max("total")).alias("__dry")]
    return materialise(lines.groupBy("__host", "__content").agg(*found, *([F.collect_set("line").alias("__hit")] if listed else [])), "hits")


def _stripped(text_col: str):
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: ~F.array_contains("__hit", F.xxhash64(_normal(x))))
    return F.when(F.col("__hit").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))


def strip_frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", at_least: int = 5, share: float = 0.01, counted: DataFrame | None = None) -> DataFrame:
    """docs with the lines above the limits of frequent_lines() removed from the text. counted: the documents in which lines are counted, if others too.

    Null texts stay null; repeated rows lose the same lines; an empty table gives an empty result; other columns stay as they are.
    """
    rows = _content(without(docs, _OWN), text_col, host_col)
    bad = frequent_lines(docs if counted is None else counted, text_col, host_col, at_least, share).groupBy("__host", "__content").agg(F.collect_set("line").alias("__hit"))
    bad = materialise(bad, "frequent")
    return rows.join(bad, ["__host", "__content"], "left").withColumn(text_col, _stripped(text_col)).select(*[f"`{c}`" for c in without(docs, _OWN).columns])


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", at_least: int = 5, share: float = 0.01, min_left: float = 0.3, min_words: int = 50, max_repeat_pct: int = 50, listed: bool = False) -> DataFrame:
    """docs with the counts of text_counts(), n_frequent_lines, base_failed, depleted and kept.

    base_failed: fewer than min_words words, or more than max_repeat_pct per cent of the words in repeated windows.
    depleted: the document has lines above the limits of frequent_lines(), and less their words (of each once) it has
    fewer than min_words, or its other lines have less than `min_left` of the characters of its distinct lines. kept: neither. Null text counts as empty and fails; a null
    host is a host of its own, shared with the empty name. Repeated rows are judged alike; an empty table gives an empty result. Columns with an added name are
    replaced. With listed, __hit has the hashes of the frequent lines of each document.
    """
    rows = without(docs, [*ADDED, *_OWN])
    hits = _hits(frequent_lines(rows, text_col, host_col, at_least, share), min_left, listed)
    # Counted before the join, so that texts move only if they are wanted.
    return (
        text_counts(_content(rows, text_col, host_col), text_col).join(hits, ["__host", "__content"], "left")
        .withColumn("depleted", F.coalesce(F.col("__dry") | (F.col("n_words") - F.col("__fewer") < min_words), F.lit(False)))
        .withColumn("n_frequent_lines", F.coalesce("n_frequent_lines", F.lit(0).cast("long")))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop("__host", "__content", "__dry", "__fewer")
    )


def drop_poor_documents(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The documents that quality_rules() keeps, with the columns of docs, whatever they are called. Null and empty texts go; repeated rows are judged alike; an empty table gives an empty result."""
    return _kept(docs, False, text_col, rules)


def clean_documents(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The documents that quality_rules() keeps, without their frequent lines, counted before any document went; the columns of docs, whatever they are called. Null and empty texts go; repeated rows are judged and stripped alike; an empty table gives an empty result."""
    return _kept(docs, True, text_col, rules)


def _kept(docs: DataFrame, strip: bool, text_col: str, rules: dict) -> DataFrame:
    aside = {c: f"__own_{c}" for c in docs.columns if c.lower() in ADDED}
    judged = quality_rules(docs.withColumnsRenamed(aside), text_col, listed=strip, **rules).where("kept").drop(*ADDED)
    if strip:
        judged = judged.withColumn(text_col, _stripped(text_col))
    return judged.withColumnsRenamed({v: k for k, v in aside.items()}).select(*[f"`{c}`" for c in docs.columns])
