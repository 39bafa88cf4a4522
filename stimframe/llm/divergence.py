"""Source divergence audit: how far the term counts of a language's sources lie apart, and in which terms."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stimframe.llm.common import UPPER
from stimframe.session import materialise

#: Probabilities are in units of this share; a stream of count vectors has about so many; a task counts so many terms before it sends their sums.
UNIT_DIGITS, STREAM, HELD = 3, 20_000, 400_000
#: Cells of a block of count vectors by sources, and up to how many sources the sums of all their pairs are held until a stream ends.
CELLS, DENSE = 1 << 18, 1024
#: Bytes that are no part of a term (all ASCII but letters) become blanks, A-Z lower case; all others stay.
_FOLD = bytes(b + 32 if chr(b) in UPPER else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_VEC = "array<struct<source:string,n:bigint>>"


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the documents with it.

    Terms are the runs of letters (and of all beyond ASCII), A-Z lower-cased. Each task sums its own documents first; so a hot
    source or term moves once for each task. Null texts, languages and sources count as empty; repeated rows are documents
    like others; an empty table gives an empty result.
    """

    def rows(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in groups.items():
            if n:
                sizes = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*sizes, pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held = {}, 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                terms, before = text.translate(_FOLD).split(), len(n)
                n.update(terms)
                d.update(set(terms))
                held += len(n) - before
                if held > HELD:
                    yield from rows(groups)
                    groups, held = {}, 0
        yield from rows(groups)

    named = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    parts = named.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def count_vectors(counts: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, vec, terms, mult): the distinct sparse vectors of counts by source, from rows of term_counts().

    A language keeps the terms in at least min_docs of its documents. Terms with one and the same vector are one row: mult is
    how many they are, terms the first `top` of them in UTF-8 order (no later one can be among the first `top` of a source).
    A vector is grouped as a whole, not by a hash of it; one that very many terms share is counted, and its terms are cut to
    `top`, in the tasks that hold them before they meet.
    """
    kept = counts.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).cast(_VEC).alias("vec"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = materialise(kept.select("lang", "term", "vec"), "kept-terms")
    nth = F.row_number().over(Window.partitionBy("lang", "vec").orderBy("term"))
    first = kept.withColumn("__nth", nth).where(F.col("__nth") <= top).groupBy("lang", "vec").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return kept.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("mult")).join(first, ["lang", "vec"])


def probabilities(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(1000000000 * (count + 1) / total) exactly, three digits at a time, for totals of at least count + 1 and up to 9e15."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(UNIT_DIGITS):
        rest = rest * 1000
        digits = rest // totals
        out, rest = out * 1000 + digits, rest - digits * totals
    return out + 1


class _Sums:
    """Of one language: the sums of every pair of sources and the first terms of each source, over the count vectors that it is shown."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], n_terms: int, top: int):
        self.lang, self.sources, self.top = lang, sources, top
        self.index = pa.array(sources, pa.string())
        self.totals = np.array(totals, np.int64) + n_terms
        self.all = np.array([sum(totals) + n_terms], np.int64)
        self.pairs = np.zeros((len(sources), len(sources)), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in sources]
        self.seen = False

    def add(self, vec: pa.ListArray, mult: np.ndarray, terms: pa.ListArray) -> None:
        flat = vec.flatten()
        rows = np.repeat(np.arange(len(vec)), np.diff(vec.offsets.to_numpy()))
        c = np.zeros((len(vec), len(self.sources)), np.int64)
        c[rows, pc.index_in(flat.field("source"), value_set=self.index).to_numpy()] = flat.field("n").to_numpy()
        p, q = probabilities(c, self.totals), probabilities(c.sum(1), self.all)
        for k in range(len(self.sources)):
            d = p[:, k : k + 1] - p
            self.pairs[k] += mult @ (d * d // p)
            self._rank(k, c[:, k], p[:, k], q, mult, terms)
        self.seen = True

    def _rank(self, k: int, c: np.ndarray, p: np.ndarray, q: np.ndarray, mult: np.ndarray, terms: pa.ListArray) -> None:
        at = np.flatnonzero((c > 0) & (p > q))
        value = (p[at] - q[at]) ** 2 // q[at]
        best = self.best[k]
        if len(best) == self.top:
            hopeful = value >= -best[-1][0]
            at, value = at[hopeful], value[hopeful]
        if not len(at):
            return
        down = np.argsort(-value, kind="stable")
        enough = np.searchsorted(np.cumsum(mult[at[down]]), self.top)
        least = value[down[min(enough, len(down) - 1)]]
        for i, v in zip(at[value >= least].tolist(), value[value >= least].tolist()):
            best.extend((-v, t) for t in terms[i].as_py())
        # Python compares strings by code points, which is the order of their UTF-8 bytes.
        self.best[k] = heapq.nsmallest(self.top, best)

    def spill(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The sums of pairs, and at the end the first terms."""
        if not self.seen:
            return
        n = len(self.sources)
        for k, source in enumerate(self.sources):
            out = [("pair", item, value) for j, (item, value) in enumerate(zip(self.sources, self.pairs[k].tolist())) if j != k]
            out += [("term", t, -v) for v, t in self.best[k]] if last else []
            if out:
                part, item, value = zip(*out)
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(out), pa.string()) for x in (self.lang, source)), *(pa.array(x, pa.string()) for x in (part, item)), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])
        self.pairs = np.zeros((n, n), np.int64)


def _evaluate(top: int):
    """For mapInArrow over streams of rows by language, with a row of the language's sources and their totals before its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Sums | None = None
        for batch in batches:
            first = batch.column("first").to_numpy(zero_copy_only=False)
            edges = [0, *[e for k in np.flatnonzero(first).tolist() for e in (k, k + 1)], batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if first[a]:
                    lang = batch.column("lang")[a].as_py()
                    if now is None or now.lang != lang:
                        if now:
                            yield from now.spill(True)
                        listed = batch.column("vec")[a].as_py()
                        now = _Sums(lang, [x["source"] for x in listed], [x["n"] for x in listed], batch.column("mult")[a].as_py(), top)
                    continue
                step = max(1, CELLS // len(now.sources))
                for at in range(a, b, step):
                    part = batch.slice(at, min(step, b - at))
                    now.add(pa.concat_arrays([part.column("vec")]), part.column("mult").to_numpy(), part.column("terms"))
                    if len(now.sources) > DENSE:
                        yield from now.spill(False)
        if now:
            yield from now.spill(True)

    return run


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the others of its language, and its `top` telling terms.

    A language keeps the V terms in at least min_docs of its documents. With N occurrences of them in a source, a term with
    `count` of them has p = 1 + floor(10**9 * (count + 1) / (N + V)); q is the same of the other source, or of the whole language. Part
    `pair` is the sum over kept terms of floor((p - q)**2 / q) for every other source, part `term` that value of each term of the source
    with p > q. Ranks are by value, then by item in UTF-8 order.

    Terms are grouped by their count vectors (see count_vectors): each pair of sources is evaluated once for each distinct vector
    and counts as often as terms share it. Vectors are dealt to streams by a hash, so that a language with most of them is no single task;
    a task holds the sources of a language and the sums of their pairs, sent on at once if there are more than DENSE sources.
    All arithmetic is in integers. The result has a row for each pair of sources of a language, and so has what moves at the end.

    Null texts, languages and sources count as empty; a source without terms takes part with counts of 0, and a language without
    kept terms has values of 0; repeated rows are documents like others; an empty table gives an empty result.
    """
    counts = term_counts(docs, text_col, lang_col, source_col)
    vectors = materialise(count_vectors(counts, min_docs, top), "count-vectors")
    every = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source")).distinct()
    totals = vectors.select("lang", "mult", F.explode("vec").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("e.n") * F.col("mult")).alias("n"))
    sources = every.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).cast(_VEC).alias("vec"))
    langs = materialise(sources.join(vectors.groupBy("lang").agg(F.sum("mult").alias("mult")), "lang", "left"), "languages")
    streams = max(8, math.ceil(vectors.count() / STREAM))
    dealt = vectors.withColumn("stream", F.pmod(F.xxhash64("vec"), F.lit(streams)))
    heads = dealt.select("lang", "stream").distinct().join(langs, "lang").select("lang", "stream", F.lit(True).alias("first"), "vec", "mult", F.array().cast("array<string>").alias("terms"))
    both = heads.unionByName(dealt.select("lang", "stream", F.lit(False).alias("first"), "vec", "mult", "terms"))
    parts = (
        both.repartition("lang", "stream").sortWithinPartitions("lang", "stream", F.desc("first")).select("lang", "first", "vec", "mult", "terms")
        .mapInArrow(_evaluate(top), "lang string, source string, part string, item string, value long")
    )
    parts = materialise(parts, "divergence")
    # A language without kept terms has no vector and so no stream.
    bare = langs.where("mult is null").select("lang", "vec", F.explode("vec.source").alias("source")).select("lang", "source", F.explode("vec.source").alias("item")).where("source <> item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(bare.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", nth).unionByName(parts.where("part = 'term'").withColumn("rank", nth).where(F.col("rank") <= top))
