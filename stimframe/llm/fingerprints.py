"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stimframe.llm.common import without
from stimframe.session import materialise

#: Two primes under 2**31, so that a product of two residues fits in 63 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
#: Prefix arrays are made for rows of about so many code points at a time (40 bytes each), a longer text by itself.
CHARS = 1 << 21
ADDED = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_OWN = ("__text", "__order", "__kind", "__pid", "__next")
#: Where a prefix ends (one number for each row) to its two residues.
Prefix = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


class PrefixHashes:
    """The prefix arrays of several texts: of each, the polynomial hash modulo two primes up to every code point.

    Any span's hash is a difference of two entries, scaled to its place by a power of the base; so whether two spans are equal takes
    constant time, and how far two texts agree takes a binary search. A text's codes are raised by one, so that no text hashes like a
    shorter one with nothing before it. Bases are keyed by a seed. Equal spans always have equal hashes; different ones
    of up to n code points do with a chance of about (n / 2**31)**2.
    """

    def __init__(self, seed: int = 11):
        digests = [hashlib.sha256(f"{seed}:{k}".encode()).digest() for k in range(len(PRIMES))]
        self.bases = [int.from_bytes(d[:8], "big") % (p - 256) + 128 for d, p in zip(digests, PRIMES)]
        self._powers = [np.ones(1, np.int64) for _ in PRIMES]

    def read(self, texts: list[str]) -> PrefixHashes:
        """From now on of these texts."""
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self._grow(int(self.lengths.max(initial=0)) + 1)
        place = np.arange(len(codes)) - np.repeat(self.starts, self.lengths)
        self._sums = [np.concatenate(([0], np.cumsum(codes * w[place] % p))) for w, p in zip(self._powers, PRIMES)]
        return self

    def _grow(self, n: int) -> None:
        for k, p in enumerate(PRIMES):
            w = self._powers[k]
            while len(w) < n:  # w[i + len] = w[i] * base ** len
                w = np.concatenate((w, w * (int(w[-1]) * self.bases[k] % p) % p))
            self._powers[k] = w

    def power(self, k: int, n: np.ndarray) -> np.ndarray:
        return self._powers[k][n]

    def prefix(self, rows: np.ndarray) -> Prefix:
        """Hashes of the first so many code points of the texts of these numbers."""
        at = self.starts[rows]
        return lambda n: tuple((s[at + n] - s[at]) % p for s, p in zip(self._sums, PRIMES))

    def joined(self, a: Prefix, cut: np.ndarray, b: Prefix) -> Prefix:
        """Hashes of prefixes of the first `cut` code points of a, and then b, from their hashes alone."""

        def run(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            left, right = a(np.minimum(n, cut)), b(np.maximum(n - cut, 0))
            return tuple((x + self.power(k, cut) * y) % p for k, (x, y, p) in enumerate(zip(left, right, PRIMES)))

        return run

    def same(self, a: Prefix, i: np.ndarray, b: Prefix, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n code points of a from i on and of b from j on are the same."""
        ok = np.ones(len(n), bool)
        for k, (x, y, u, v, p) in enumerate(zip(a(i + n), a(i), b(j + n), b(j), PRIMES)):
            ok &= (x - y) % p * self.power(k, j) % p == (u - v) % p * self.power(k, i) % p
        return ok

    def forward(self, a: Prefix, i: np.ndarray, b: Prefix, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many code points, up to `most`, a from i on and b from j on have in common."""
        return self._search(lambda n: self.same(a, i, b, j, n), most)

    def backward(self, a: Prefix, i: np.ndarray, b: Prefix, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many code points, up to `most`, a has in common before i with b before j."""
        return self._search(lambda n: self.same(a, i - n, b, j - n, n), most)

    @staticmethod
    def _search(ok: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            yes = ok(mid)
            low, high = np.where(yes, mid, low), np.where(yes, high, mid - 1)
        return low

    def likeness(self, a: Prefix, n: np.ndarray, b: Prefix, m: np.ndarray) -> np.ndarray:
        """The share of the longer text that is their common beginning and, apart from it, their common end; 1 for two empty ones."""
        zero, short = np.zeros_like(n), np.minimum(n, m)
        begin = self.forward(a, zero, b, zero, short)
        return (begin + self.backward(a, n, b, m, short - begin)) / np.maximum(np.maximum(n, m), 1) + (np.maximum(n, m) == 0)

    def names(self, a: Prefix, n: np.ndarray) -> list[str]:
        """What stands for a whole text: its length and both residues."""
        return [f"{k:x}-{x:08x}{y:08x}" for k, x, y in zip(n.tolist(), *(r.tolist() for r in a(n)))]


def _chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` code points."""
    a = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, k
            a, size = k, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def common_extensions(pairs: DataFrame, left: str, right: str, at_left: str, at_right: str, length: str | None = None, seed: int = 11) -> DataFrame:
    """pairs with forward and backward: how many code points the two texts have in common from their places on, and before them.

    at_left and at_right are columns of 0-based places, cut to the texts' ends. With `length` there is also `equal`: whether the spans
    of so many code points from there are the same, in full (false past an end of either). Null texts count as empty, null
    places as 0, a null length gives a null; added columns replace others of their names; every row is by itself, with no shuffle.
    """
    rows = without(pairs, ["forward", "backward", "equal", *_OWN])
    more, names = ["forward", "backward", *(["equal"] if length else [])], rows.columns
    cols = [F.coalesce(F.col(c), F.lit("")).alias(f"__{k}") for k, c in (("a", left), ("b", right))] + [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(f"__{k}") for k, c in (("i", at_left), ("j", at_right))]
    cols += [F.col(length).cast("long").alias("__n")] if length else []
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema], *[T.StructField(c, T.BooleanType() if c == "equal" else T.LongType()) for c in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = PrefixHashes(seed)
        for whole in batches:
            a, b = whole.column("__a").to_pylist(), whole.column("__b").to_pylist()
            for lo, hi in _chunks([x + y for x, y in zip(a, b)], CHARS):
                batch, n = whole.slice(lo, hi - lo), hi - lo
                h.read(a[lo:hi] + b[lo:hi])
                x, y, nx, ny = h.prefix(np.arange(n)), h.prefix(np.arange(n, 2 * n)), h.lengths[:n], h.lengths[n:]
                i, j = (np.clip(batch.column(c).to_numpy(), 0, m) for c, m in (("__i", nx), ("__j", ny)))
                found = [pa.array(h.forward(x, i, y, j, np.minimum(nx - i, ny - j))), pa.array(h.backward(x, i, y, j, np.minimum(i, j)))]
                if length:
                    wanted = batch.column("__n").fill_null(0).to_numpy()
                    fits = (wanted >= 0) & (wanted <= np.minimum(nx - i, ny - j))
                    found.append(pa.array(fits & h.same(x, i, y, j, np.where(fits, wanted, 0)), mask=batch.column("__n").is_null().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], names=[*names, *more])

    return rows.select(*[F.col(f"`{c}`") for c in names], *cols).mapInArrow(run, out)


def _compared(h: PrefixHashes, texts: list[str], now: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    """The values of ADDED for the texts numbered `now`, each followed by that numbered `after`."""
    h.read(texts)
    a, b, n, m = h.prefix(now), h.prefix(after), h.lengths[now], h.lengths[after]
    taken = n // 3
    cut, size = n - taken, n - taken + np.minimum(taken, m)
    edited = h.joined(a, cut, b)
    digests = [hashlib.sha256((texts[i][:c] + texts[j][:t]).encode("utf-8", "surrogatepass")).hexdigest() for i, j, c, t in zip(now.tolist(), after.tolist(), cut.tolist(), taken.tolist())]
    return [pa.array(n), pa.array(digests), pa.array(h.names(a, n)), pa.array(h.names(edited, size)), pa.array(h.likeness(a, n, edited, size)), pa.array(h.likeness(a, n, b, m))]


def fingerprint(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 11, carry: list[str] | None = None) -> DataFrame:
    """All rows of docs with n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited and near_next.

    A text's fingerprint is its array of prefix hashes (see PrefixHashes); the column has what the array says of the whole text: the
    length and two residues of 31 bits. The edited text has the last third of its code points replaced by as many of the beginning of the
    next document (by descending id, the last followed by the first); its array is composed from those of both texts, without reading
    them again. Two fingerprints are as alike as the longest common extensions from both ends, found by binary search in the arrays,
    cover the longer text: 1 for equal texts alone, 0 if they neither begin nor end alike.

    Rows are range-partitioned and sorted by id, so each text moves once; a partition's last row meets the first of the next one by a join of
    two rows for each partition. Arrays are made for some 2 million code points at a time: a task needs 40 bytes for each code
    point of the longest text. Null texts count as empty, null ids come last; rows of one id are in the order of a hash of their
    texts; repeated rows are rows like others; a single row is its own next; an empty table gives an empty result. Columns with an
    added name are replaced; carry names the columns to return if not all are wanted.
    """
    rows = without(docs, [*ADDED, *_OWN])
    names = carry or rows.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [F.col(id_col).desc_nulls_last(), F.col("__order")]
    dealt = (
        rows.select(*[F.col(f"`{n}`") for n in {**dict.fromkeys(names), id_col: None}], text.alias("__text"), F.xxhash64(text).alias("__order"))
        .repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{n}`") for n in names], "__text")
    )
    kinds = [T.LongType(), *[T.StringType()] * 3, *[T.DoubleType()] * 2]
    result = T.StructType([*[T.StructField(n, rows.schema[n].dataType) for n in names], *[T.StructField(c, t) for c, t in zip(ADDED, kinds)]])
    marked = T.StructType([*result, T.StructField("__text", T.StringType()), T.StructField("__kind", T.IntegerType()), T.StructField("__pid", T.IntegerType())])

    def finish(batch: pa.RecordBatch, found: list[pa.Array], text: list[str | None], kind: int, pid: int) -> pa.RecordBatch:
        n = batch.num_rows
        own = [batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*own, *found, pa.array(text, pa.string()), pa.repeat(pa.scalar(kind, pa.int32()), n), pa.repeat(pa.scalar(pid, pa.int32()), n)], names=[*names, *ADDED, "__text", "__kind", "__pid"])

    def edge(batch: pa.RecordBatch, text: str, kind: int, pid: int) -> pa.RecordBatch:
        return finish(batch, [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())], [text], kind, pid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose next is in the partition (kind 0), the partition's first row's text (1), and its last row (2)."""
        h, pid, held = PrefixHashes(seed), TaskContext.get().partitionId(), None
        for whole in batches:
            every = whole.column("__text").to_pylist()
            for lo, hi in _chunks(every, CHARS):
                batch, texts = whole.slice(lo, hi - lo), every[lo:hi]
                if held is None:
                    yield edge(batch.slice(0, 1), texts[0], 1, pid)
                else:
                    batch, texts = pa.concat_batches([held, batch]), [held.column("__text")[0].as_py(), *texts]
                held = batch.slice(len(texts) - 1)
                if len(texts) > 1:
                    at = np.arange(len(texts) - 1)
                    yield finish(batch.slice(0, len(at)), _compared(h, texts, at, at + 1), [None] * len(at), 0, pid)
        if held is not None:
            yield edge(held, held.column("__text")[0].as_py(), 2, pid)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = PrefixHashes(seed)
        for whole in batches:
            for k in range(whole.num_rows):
                batch = whole.slice(k, 1)
                found = _compared(h, [batch.column(c)[0].as_py() for c in ("__text", "__next")], np.array([0]), np.array([1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], names=[*names, *ADDED])

    done = materialise(dealt.mapInArrow(run, marked), "fingerprints")
    heads = done.where("__kind = 1").select("__pid", F.col("__text").alias("__next"))
    every = Window.orderBy("__pid")  # a number for each partition
    after = heads.select(F.col("__pid").alias("__of"), F.coalesce(F.lead("__pid").over(every), F.first("__pid").over(every)).alias("__pid"))
    tails = done.where("__kind = 2").select(*[F.col(f"`{n}`") for n in names], "__text", F.col("__pid").alias("__of"))
    last = tails.join(after, "__of").join(heads, "__pid").select(*[F.col(f"`{n}`") for n in names], "__text", "__next")
    return done.where("__kind = 0").select(*[F.col(f"`{n}`") for n in result.names]).unionByName(last.mapInArrow(join, result))
