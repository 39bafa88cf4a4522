"""Spans of pattern matches as arrays, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Offsets are summed over blocks of so many matches, so that the work stays near linear in the number of matches.
BLOCK = 64


def find_spans(df: DataFrame, text: str, kind: str, pattern: str, to: str, hint: str | None = None, keep: str = "true") -> DataFrame:
    """df with column `to`: array of struct(kind, start, stop, m) of the leftmost non-overlapping matches in the text column.

    start and stop count code points from 0, stop exclusive. hint is a string without which no match is possible; keep is
    a SQL condition on m (the match), and those that fail it are dropped. Matches and the pieces between them come from two
    passes of the same pattern; a text without a match isn't cut. Every column is named twice where it is used (once in
    the CASE), as the optimizer would else move its expression into the lambda function, to run for each match.
    """
    m, cut, lens, sums = (f"__{to}_{k}" for k in ("m", "cut", "lens", "sums"))
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return (
        df.withColumn(m, F.when(F.contains(text, F.lit(hint)), found).otherwise(none) if hint else found)
        .withColumn(cut, F.when(F.size(m) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
        .withColumn(lens, F.expr(f"case when size({m}) > 0 and size({cut}) > 0 then transform({m}, (x, i) -> length(x) + length({cut}[i])) else array() end"))
        .withColumn(sums, F.expr(f"case when size({lens}) > 0 then transform(sequence(0, size({lens}) div {BLOCK}), b -> aggregate(slice({lens}, 1, b * {BLOCK}), 0, (a, x) -> a + x)) else array() end"))
        .withColumn(to, F.expr(
            f"filter(case when size({m}) > 0 and size({cut}) > 0 and size({lens}) > 0 and size({sums}) > 0 then transform(transform({m}, (x, i) -> struct(x as m, {sums}[cast(i div {BLOCK} as int)] + aggregate(slice({lens}, cast(i div {BLOCK} as int) * {BLOCK} + 1, i % {BLOCK}), 0, (a, y) -> a + y) + length({cut}[i]) as start)),"
            f" s -> struct('{kind}' as kind, s.start as start, s.start + length(s.m) as stop, s.m as m)) else array() end, s -> {keep.replace('{m}', 's.m')})"
        ))
        .drop(m, cut, lens, sums)
    )


def as_text(spans: str) -> str:
    """SQL for kind:start:end of an array of spans, comma-joined in the array's order."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"


def by_start(spans: str, kinds: list[str]) -> str:
    """SQL for the array ordered by start, then by kind as listed."""
    listed = ", ".join(repr(k) for k in kinds)
    a, b = (f"struct({x}.start, array_position(array({listed}), {x}.kind))" for x in "ab")
    return f"array_sort({spans}, (a, b) -> case when {a} < {b} then -1 when {a} > {b} then 1 else 0 end)"


def overlaps(spans: str, s: str) -> str:
    """SQL for whether the span s overlaps one of an array of spans in order that don't overlap each other; by bisection."""
    mid = "((r.lo + r.hi) div 2)"
    first = (
        f"aggregate(sequence(0, cast(ceil(log2(size({spans}) + 1)) as int)), struct(0L as lo, cast(size({spans}) as bigint) as hi), (r, i) -> case when r.lo >= r.hi then r"
        f" when {spans}[{mid}].stop > {s}.start then struct(r.lo as lo, {mid} as hi) else struct({mid} + 1 as lo, r.hi as hi) end, r -> cast(r.lo as int))"
    )
    return f"(size({spans}) > 0 and coalesce(get({spans}, {first}).start < {s}.stop, false))"
