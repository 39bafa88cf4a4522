"""SentencePiece encoding with seeded merge dropout, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stimframe.llm.common import without

#: How many keys of one segment the tests compare; texts are encoded with a key of its own for every document and position.
VARIETIES = 8
#: Segments of up to so many characters are merged together, in arrays of these widths; longer ones one by one, with a heap.
WIDTHS = (12, 24, 48)
#: Entries (segments, and segments without one candidate) that a task remembers, and the characters of texts that it encodes at a time (one text at least).
REMEMBERED, CHUNK = 800_000, 2_000_000
ADDED = ("ids", "n_tokens", "lossless")
_MASK = (1 << 64) - 1
#: Symbols in arrays: ids of pieces, then characters that are no pieces from _CHARS on, then none.
_CHARS, _BASE = 1 << 24, (1 << 24) + 0x110000 + 1
_NONE, _NEVER = _BASE - 1, 1 << 40
_MAY_BITS = 21


class _Slots(dict):
    """Segments to their entries in the codec; one that is new gets the next entry and is noted."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, segment: str) -> int:
        self.codec.pending.append(segment)
        self[segment] = entry = len(self.codec.counts) + len(self.codec.pending) - 1
        return entry


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 64 bits to 64 bits, so that numbers that differ by a fixed amount are unrelated after it."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mixed_one(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def _pair_hash(pairs: np.ndarray) -> np.ndarray:
    return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MAY_BITS)


def _candidate(begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """What a candidate adds to the key of its segment's place."""
    return begin.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + stop.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


class Codec:
    """BPE over the pieces of a model: of all adjacent symbols that join to a piece, the best-scored and leftmost join first.

    Space stands for the model's space mark, so that the mark itself, if a text has it, is spelled in bytes like any
    character that is no piece. A text is cut into segments that no piece can span: before a space that follows another
    character and around line ends. A model with other pieces is refused.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], unknown: int, spelled: dict[int, int], dropout: float = 0.0, seed: int = 0):
        self.ids = {p: i for p, _, i in pieces}
        places = {score: k for k, score in enumerate(sorted({score for _, score, _ in pieces}, reverse=True))}
        self.ranks = {p: places[score] for p, score, _ in pieces}  # pieces of one score share a rank, so that the leftmost comes first
        self.unknown, self.dropout, self.seed = unknown, int(dropout * 2**64), seed
        self.bytes_of = {i: p.encode() for p, _, i in pieces} | {i: bytes([b]) for b, i in spelled.items()}
        self.spelled = spelled
        sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)])
        self.byte_sizes, self.byte_begins = sizes, np.cumsum(sizes) - sizes
        self.every_byte = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(sizes))), np.uint8)
        if any(" " in p.lstrip(" ") or "\n" in p and len(p) > 1 for p, _, _ in pieces) or len(spelled) < 256:
            raise ValueError("the model has pieces over several words, or no pieces for bytes")
        self.segments = re.compile(r" *[^ \n]+|\n| +").findall
        self.codes = np.arange(_BASE - 1 - _CHARS) + _CHARS  # of single characters
        for p, i in self.ids.items():
            if len(p) == 1:
                self.codes[ord(p)] = i
        self.join_keys, self.join_ranks, self.join_ids = self.joins()
        self.may_join = np.zeros(1 << _MAY_BITS, bool)  # by a hash of a pair: most pairs don't join, and need no search
        self.may_join[_pair_hash(self.join_keys)] = True
        self.forget()

    def joins(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every way to make a piece of two symbols: the pair as one number, ascending, the piece's rank and its id."""
        code = lambda x: self.ids.get(x, _CHARS + ord(x) if len(x) == 1 else None)
        found = [(a * _BASE + b, self.ranks[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := code(p[:k])) is not None and (b := code(p[k:])) is not None]
        found.append((1 << 62, _NEVER, 0))
        return tuple(np.array(x, np.int64) for x in zip(*sorted(found)))

    def merged(self, segment: str, place: int) -> tuple[int, ...]:
        """Ids of a segment. A candidate that comes up on the agenda is skipped if a hash of seed, place in the corpus, begin and end falls under the dropout."""
        rank, n, drop = self.ranks.get, len(segment), self.dropout
        key = _mixed_one((place + self.seed * 0xD6E8FEB86659FD93) & _MASK)
        end = list(range(1, n + 1))  # of the symbol that begins there; 0: none begins there
        before = list(range(-1, n - 1))
        side = n + 1  # a candidate is one number: rank, begin, end
        agenda = [(r * side + k) * side + k + 2 for k in range(n - 1) if (r := rank(segment[k : k + 2])) is not None]
        heapify(agenda)
        while agenda:
            rest, stop = divmod(heappop(agenda), side)
            a = rest % side
            mid = end[a]
            if not mid or mid >= n or end[mid] != stop:
                continue
            if drop:
                if _mixed_one((key + a * 0x9E3779B97F4A7C15 + stop * 0xC2B2AE3D27D4EB4F) & _MASK) < drop:
                    continue
            end[a], end[mid] = stop, 0
            if stop < n:
                before[stop] = a
                if (r := rank(segment[a : end[stop]])) is not None:
                    heappush(agenda, (r * side + a) * side + end[stop])
            if a and (r := rank(segment[before[a] : stop])) is not None:
                heappush(agenda, (r * side + before[a]) * side + stop)
        ids, at, known = [], 0, self.ids.get
        while at < n:
            found = known(segment[at : end[at]])
            if found is None:
                ids.extend([self.spelled[b] for b in segment[at : end[at]].encode()])
            else:
                ids.append(found)
            at = end[at]
        return tuple(ids)

    def keys(self, places: np.ndarray) -> np.ndarray:
        """Of places in the corpus: what their skips are drawn from."""
        return _mixed(places + np.uint64(self.seed * 0xD6E8FEB86659FD93 & _MASK))

    def merged_together(self, segments: list[str], places: list[int] | np.ndarray | None, width: int, order: list[tuple[np.ndarray, np.ndarray]] | None = None, without: np.ndarray | None = None) -> list[tuple[int, ...]]:
        """As merged(), for many segments of up to width characters: each step takes the best candidate of every segment.

        With no places nothing is skipped but the one candidate of each segment in `without`, by what it adds to the key. order
        takes the steps: which segments merged, and what the candidate adds to their keys.
        """
        n, w = len(segments), width + 2  # the last column stands before the first symbol, the one before it after the last
        sizes = np.fromiter(map(len, segments), np.int64, n)
        row = np.repeat(np.arange(n), sizes)
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbols = np.full(n * w, _NONE)
        symbols[row * w + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = self.codes[points]
        follows, before = np.tile(np.arange(1, w + 1), n), np.tile(np.arange(-1, w - 1), n)
        before[::w] = w - 1
        left = symbols.reshape(n, w)
        rank, join = (x.reshape(n, w) for x in self.joined(symbols, np.column_stack([left[:, 1:], np.full(n, _NONE)]).ravel()))
        alive, flat_rank, flat_join = symbols != _NONE, rank.ravel(), join.ravel()
        drop = self.dropout if places is not None else 0
        keys = self.keys(np.array(places, np.uint64)) if drop else None
        rows = np.arange(n)
        while len(rows):
            a = rank[rows].argmin(1)
            here = rows * w + a
            live = flat_rank[here] != _NEVER
            rows, a, here = rows[live], a[live], here[live]
            base, mid = here - a, follows[here]
            stop = follows[base + mid]
            if drop or without is not None:
                skip = _mixed(keys[rows] + _candidate(a, stop)) < np.uint64(drop) if drop else _candidate(a, stop) == without[rows]
                flat_rank[here[skip]] = _NEVER
                take = ~skip
                a, here, base, mid, stop = a[take], here[take], base[take], mid[take], stop[take]
            if order is not None:
                order.append((rows if len(rows) == len(a) else rows[take], _candidate(a, stop)))
            symbols[here] = self.join_ids[flat_join[here]]
            alive[base + mid], flat_rank[base + mid] = False, _NEVER
            follows[here], before[base + stop] = stop, a
            flat_rank[here], flat_join[here] = self.joined(symbols[here], symbols[base + stop])
            prior = base + before[here]
            flat_rank[prior], flat_join[prior] = self.joined(symbols[prior], symbols[here])
        ends = np.cumsum(alive.reshape(n, w).sum(1)).tolist()
        ids = symbols[alive].tolist()
        out = [tuple(ids[i:j]) for i, j in zip([0, *ends], ends)]
        for k in np.unique(np.flatnonzero(alive & (symbols >= _CHARS)) // w).tolist():  # characters that are no pieces
            out[k] = tuple(x for i in out[k] for x in ([i] if i < _CHARS else [self.spelled[b] for b in chr(i - _CHARS).encode()]))
        return out

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the table of the pieces that pairs of symbols join to."""
        pairs = left * _BASE + right
        at = np.full(len(pairs), len(self.join_keys) - 1)
        may = np.flatnonzero(self.may_join[_pair_hash(pairs)])
        at[may] = np.searchsorted(self.join_keys, some := pairs[may])
        at[may[self.join_keys[at[may]] != some]] = len(self.join_keys) - 1
        return self.join_ranks[at], at

    def learn(self, segments: list[str], without: np.ndarray | None = None) -> None:
        """Entries for segments: their ids if nothing is skipped (but the candidates in `without`), and the merges that lead there."""
        found: list[tuple[int, ...]] = [()] * len(segments)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        for some, width in self.parts(sizes):
            order: list[tuple[np.ndarray, np.ndarray]] | None = [] if self.dropout else None
            for k, ids in zip(some.tolist(), self.merged_together([segments[k] for k in some.tolist()], None, width, order, None if without is None else without[some])):
                found[k] = ids
            steps.extend((some[rows], adds) for rows, adds in order or ())
        if not self.dropout:  # with it each is merged where it stands
            for k in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
                found[k] = self.merged(segments[k], 0)
        rows = np.concatenate([r for r, _ in steps]) if steps else np.empty(0, np.int64)
        sort = np.argsort(rows, kind="stable")
        counts = np.bincount(rows, minlength=len(segments))
        self.begins = np.concatenate((self.begins, len(self.adds) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.adds = np.concatenate((self.adds, np.concatenate([x for _, x in steps])[sort] if steps else np.empty(0, np.uint64)))
        self.after = np.concatenate((self.after, np.full(len(rows), -1)))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.id_begins = np.concatenate((self.id_begins, len(self.ids_held) + np.cumsum(sizes) - sizes))
        self.id_counts = np.concatenate((self.id_counts, sizes))
        self.ids_held = np.concatenate((self.ids_held, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))))

    def first_skipped(self, entries: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of occurrences (their entries and keys): which have a merge of the entry's skipped, and the place of the first such one in adds."""
        counts = self.counts[entries]
        ends = np.cumsum(counts)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        step = np.arange(ends[-1]) - np.repeat(ends - counts - self.begins[entries], counts)
        at = np.flatnonzero(_mixed(np.repeat(keys, counts) + self.adds[step]) < np.uint64(self.dropout))
        whose = np.searchsorted(ends, at, "right")
        first = np.ones(len(at), bool)
        first[1:] = whose[1:] != whose[:-1]
        return whose[first], step[at[first]]

    @staticmethod
    def parts(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Places of the segments to merge together, and their width."""
        low = 0
        for width in WIDTHS:
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(some), 20_000):
                yield some[at : at + 20_000], width
            low = width

    def encode_all(self, texts: list[str | None], documents: list[int]) -> list[list[int]]:
        """Ids of the whole texts. Every segment draws its own skips, by its document and its position there."""
        ids, ends = self.encode_flat(texts, documents)
        return [ids[i:j].tolist() for i, j in zip([0, *ends], ends)]

    def encode_flat(self, texts: list[str | None], documents: list[int]) -> tuple[np.ndarray, list[int]]:
        """The same as one array, and where each text's part ends."""
        if len(self.counts) > REMEMBERED:
            self.forget()
        cuts = [self.segments(" " + text) if text else [] for text in texts]
        flat = list(chain.from_iterable(cuts))
        entries = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        self.learn(self.pending)
        self.pending = []
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        own: dict[int, tuple[int, ...]] = {}  # of the occurrences whose ids are no entry's
        if self.dropout and flat:
            starts = _mixed(np.array([d & _MASK for d in documents], np.uint64))
            positions = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            places = np.repeat(starts, lengths) + positions.astype(np.uint64)
            keys = self.keys(places)
            # Where none of the merges without dropout is skipped, the segment is as without dropout. Where one is, it is as the entry
            # without that candidate, unless it skips another of that entry's merges; then it is merged by itself.
            varied, step = self.first_skipped(entries, keys)
            missing, unknown = varied[self.after[step] < 0], step[self.after[step] < 0]
            new, example = np.unique(unknown, return_index=True)
            if len(new):
                self.after[new] = len(self.counts) + np.arange(len(new))
                self.learn([flat[k] for k in missing[example].tolist()], self.adds[new])
            entries[varied] = self.after[step]
            again = varied[self.first_skipped(entries[varied], keys[varied])[0]]
            sizes = np.fromiter(map(len, map(flat.__getitem__, again.tolist())), np.int64, len(again))
            for some, width in self.parts(sizes):
                at = again[some].tolist()
                own.update(zip(at, self.merged_together([flat[k] for k in at], places[at], width)))
            own.update((k, self.merged(segment, int(places[k]))) for k, segment in enumerate(flat) if len(segment) > WIDTHS[-1])
        begins, counts, held = self.id_begins[entries], self.id_counts[entries], self.ids_held
        if own:
            at = np.fromiter(own, np.int64, len(own))
            sizes = np.fromiter(map(len, own.values()), np.int64, len(own))
            begins[at], counts[at] = len(held) + np.cumsum(sizes) - sizes, sizes
            held = np.concatenate((held, np.fromiter(chain.from_iterable(own.values()), np.int32, int(sizes.sum()))))
        ends = np.cumsum(counts)
        ids = held[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - begins, counts)]
        return ids, np.concatenate(([0], ends))[np.cumsum(lengths)].tolist()

    def forget(self) -> None:
        """Entries: merges from begins (counts of them) in adds, ids from id_begins in ids_held. after: the entry without that candidate, or -1."""
        self.pending: list[str] = []
        self.known = _Slots(self)
        self.begins, self.counts, self.adds, self.after = (np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
        self.id_begins, self.id_counts, self.ids_held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def spell(self, ids: np.ndarray, ends: list[int]) -> list[bytes]:
        """What the ids of each text spell, the first space included."""
        sizes = self.byte_sizes[ids]
        stops = np.cumsum(sizes)
        whole = self.every_byte[np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - sizes - self.byte_begins[ids], sizes)].tobytes()
        cut = np.concatenate(([0], stops))[ends].tolist()
        return [whole[i:j] for i, j in zip([0, *cut], cut)]

    def decode(self, ids) -> str:
        """The text of ids; other ids than those of pieces and bytes have none."""
        return b"".join(map(self.bytes_of.get, ids)).decode("utf-8", "replace")[1:]


def load_codec(model: str) -> dict:
    """What a Codec needs of a model file, read once on the driver: a fixed few hundred kB, whatever the corpus."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    every = range(sp.vocab_size())
    plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {
        "pieces": [(sp.id_to_piece(i).replace("▁", " "), sp.get_score(i), i) for i in plain],
        "unknown": sp.unk_id(),
        "spelled": {int(sp.id_to_piece(i)[1:-1], 16): i for i in every if sp.is_byte(i)},
    }


def encode(docs: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id", dropout: float = 0.1, seed: int = 20, carry: list[str] | None = None, occurrence: str | None = None) -> DataFrame:
    """docs (or its columns in carry) with ids, n_tokens and lossless, whether decoding the ids gives the text again.

    Without dropout the ids are those of the SentencePiece library. With it each merge of a segment is skipped with that
    chance, by a hash of seed, document, position of the segment and place of the merge: a document has the same ids whenever
    and wherever it is encoded, and every occurrence of a word is varied by itself. occurrence names a column that tells the rows of a document apart
    (an epoch, a place in a mix): each is then varied by itself. Null and empty texts have no ids; a null id counts as 0; repeated rows have equal ids; an
    empty table gives an empty result. Columns with an added name are replaced. Texts are taken whole, a row at a time; no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_codec(model))
    rows = without(docs, [*ADDED, "__text", "__doc"])
    names = carry or rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(**held.value, dropout=dropout, seed=seed)
        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = lengths[at - 1] if at else 0
                stop = min(max(at + 1, int(np.searchsorted(lengths, done + CHUNK, "right"))), at + 4096)
                part = batch.slice(at, stop - at)
                at = stop
                texts = part.column("__text").to_pylist()
                ids, ends = codec.encode_flat(texts, part.column("__doc").to_pylist())
                same = [spelled == (f" {text}".encode() if text else b"") for spelled, text in zip(codec.spell(ids, ends), texts)]
                lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists, pa.array(np.diff([0, *ends]), pa.int64()), pa.array(same)], names=[*names, *ADDED])

    fields = [T.StructField(n, rows.schema[n].dataType) for n in names]
    out = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType())])
    doc = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("0")), *([F.col(occurrence)] if occurrence else []))
    return rows.select(*[f"`{n}`" for n in names], F.col(text_col).alias("__text"), doc.alias("__doc")).mapInArrow(run, out)


def decode(df: DataFrame, model: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of each row's ids; null ids give null, repeated rows equal texts, an empty table an empty result."""
    held = df.sparkSession.sparkContext.broadcast(load_codec(model))

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(**held.value)
        for ids in parts:
            yield ids.map(lambda x: None if x is None else codec.decode(x))

    return df.withColumn(to, run(F.col(ids_col)))
