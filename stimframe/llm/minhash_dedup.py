"""Near-duplicate documents by HyperMinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimframe.llm.common import lower_ascii, without
from stimframe.llm.components import components, with_links
from stimframe.llm.shingles import WordHashes, overlap, shingle_set
from stimframe.session import materialise

#: A sketch: ROUNDS independent hashes of the shingles, each dealt to 2**BUCKET_BITS buckets by its leading bits.
ROUNDS, BUCKET_BITS, MANTISSA, ROWS = 16, 3, 10, 4
BUCKETS = 1 << BUCKET_BITS
REGISTERS = ROUNDS * BUCKETS
EMPTY = 0xFFFF
#: Fixed value, from the paper on HyperMinHash: chance of a collision of registers of r mantissa bits is this * 2**-r at equal sizes.
COLLISION = 0.169919487159739093975315012348
#: A large component's texts meet its smallest id in so many parts.
SALTS = 32
#: Members of a bucket that are compared with each other in one block, and rounds of centres before that.
BLOCK, CENTRES = 384, 1
ADDED = ("n_shingles", "component_id", "kept")
_SEEDS = (np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[:, None]
_BOUNDS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_U = np.uint64


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least hash in each bucket of each round, REGISTERS of them, all bits set where the bucket is empty."""
    out = np.full((ROUNDS, BUCKETS), ~_U(0), _U)
    for at in range(0, len(shingles), 1 << 16):
        h = shingles[None, at : at + (1 << 16)] ^ _SEEDS
        h *= _U(0xFF51AFD7ED558CCD)
        h ^= h >> _U(33)
        h *= _U(0xC4CEB9FE1A85EC53)
        h.sort(axis=1)
        for k in range(ROUNDS):
            i = np.searchsorted(h[k], _BOUNDS)
            found = h[k][np.minimum(i, h.shape[1] - 1)]
            held = (i < h.shape[1]) & (found >> _U(64 - BUCKET_BITS) == _BOUNDS >> _U(64 - BUCKET_BITS))
            out[k] = np.where(held, np.minimum(out[k], found), out[k])
    return out.ravel()


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and MANTISSA bits after the first one, of what follows a hash's bucket bits; EMPTY for none."""
    rest = least << _U(BUCKET_BITS)
    zeros = 53 - np.frexp((rest >> _U(11)).astype(np.float64))[1]
    mantissa = (rest << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA)
    found = ((zeros.astype(_U) << _U(MANTISSA)) | mantissa).astype(np.uint16)
    found[least == ~_U(0)] = EMPTY
    return found


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of pairs of sketches, corrected for chance collisions, and the number of registers it rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(1), 1)
    ratio = n_a / np.maximum(n_b, 1)
    chance = COLLISION * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    same = ((a == b) & used).sum(1) / n
    return (same - chance) / (1 - chance), n


def _hopeful(a, b, n_a, n_b, percent: int) -> np.ndarray:
    """Whether the similarity may reach percent: it isn't 4.5 standard errors below, nor ruled out by the sets' sizes."""
    j, n = estimate(a, b, n_a, n_b)
    p = percent / 100
    return (j >= p - 4.5 * np.sqrt(p * (1 - p) / n)) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, least = [], []
                for text in part.column("text"):
                    s = shingle_set(text.as_py(), hashes, words)
                    sizes.append(len(s))
                    least.append(least_hashes(s))
                regs = registers(np.array(least))
                yield pa.record_batch([part.column("node"), pa.array(sizes, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())], names=["node", "n", "regs"])

    return run


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each band of ROWS registers, and whether any of them holds something; (sketches, bands)."""
    plain = np.ascontiguousarray(regs).view(_U).reshape(len(regs), -1)
    mixed = (plain ^ (plain >> _U(29))) * _U(0xBF58476D1CE4E5B9) + np.arange(1, plain.shape[1] + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> _U(32))) * _U(0x94D049BB133111EB)).view(np.int64), plain != ~_U(0)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band that isn't all empty: its key, and the node."""
    for batch in batches:
        if batch.num_rows:
            keys, full = band_keys(_matrix(batch.column("regs")))
            node = np.broadcast_to(batch.column("node").to_numpy()[:, None], keys.shape)
            yield pa.record_batch([pa.array(keys[full]), pa.array(node[full])], names=["key", "node"])


def _estimated(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = _hopeful(*(_matrix(batch.column(c)) for c in ("regs_a", "regs_b")), *(batch.column(c).to_numpy() for c in ("n_a", "n_b")), percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _verified(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, sets = WordHashes(), None, None
        for batch in batches:
            good = []
            for a, b, text_a, text_b in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b"))):
                if b.as_py() != last:
                    last, sets = b.as_py(), shingle_set(text_b.as_py(), hashes, words)
                own = shingle_set(text_a.as_py(), hashes, words)
                both = overlap(own, sets)
                good.append(100 * both >= percent * (len(own) + len(sets) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _within(words: int, percent: int):
    """For applyInArrow: links between members with different labels, confirmed on full sets, one for each member and label.

    side: 0 left, 1 right and also somewhere on the left, 2 right alone. A pair counts in the first bucket that it shares, and
    so is looked at once.
    """
    hashes = WordHashes()

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, label, n, side = (group.column(c).to_numpy() for c in ("node", "label", "n", "side"))
        regs, texts, sets = _matrix(group.column("regs")), group.column("text"), {}
        keys, full = band_keys(regs)
        band = int((keys[0] == group.column("key")[0].as_py()).argmax())

        def of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_set(texts[k].as_py(), hashes, words)
            return sets[k]

        right, out = np.flatnonzero(side > 0), []
        for i in np.flatnonzero(side == 0):
            j = right[(label[right] != label[i]) & ((side[right] == 2) | (node[right] > node[i]))]
            j = j[((keys[j] == keys[i]) & full[j]).argmax(1) == band]
            if len(j):
                j = j[_hopeful(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), n[i]), n[j], percent)]
            linked = set()
            for k in j:
                if label[k] not in linked:
                    both = overlap(of(int(i)), of(int(k)))
                    if 100 * both >= percent * (n[i] + n[k] - both):
                        linked.add(label[k])
                        out.append((max(node[i], node[k]), min(node[i], node[k])))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, percent: int = 75, carry: list[str] | None = None) -> DataFrame:
    """All rows and columns of docs (or those in carry), and n_shingles, component_id and kept.

    Documents whose sets of shingles have 100 * intersection >= percent * union are linked; component_id is the smallest id
    that a document is connected with, kept is whether it is that document. In steps:

    1. Equal texts are one node: a hash of 64 bits, or where two texts share it, one made of two such hashes. A node's sketch has REGISTERS registers of 16 bits.
    2. Bands of ROWS registers give buckets, 32 for each node; at a similarity of 0.75 two nodes share none with a chance
       of 5e-6, less for higher ones. Compressed registers only ever add candidates.
    3. Each bucket has a centre, the first of its nodes in one order for all buckets. Every node is paired with the first of
       its buckets' centres, so that a group of any size gives as many pairs as nodes. Sketches rule out hopeless
       pairs, and full sets confirm the rest. Links give components.
    4. In CENTRES rounds (further ones with other orders, and so other centres): where a bucket's centre is in another
       component than a member, these two are paired and go the same way.
    5. In buckets of three or more that then still hold several components, the members outside the largest one are
       compared with all of other components, sketches first, then full sets, in blocks of BLOCK by BLOCK members spread
       over tasks; so no link between different texts is missed for want of a better centre. A block gives links alone,
       never its pairs. With these the components are final.

    Null or empty texts have no shingles and are linked with nothing. Repeated rows, of one id and text, have the same result.
    A null id takes part in links, but names a component (as null) only if no member has an id, and is kept then. Columns with an added
    name are replaced; an empty table gives an empty result.
    """
    return _judged(docs, text_col, id_col, words, percent, carry).drop("__node", "__one")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, percent: int = 75) -> DataFrame:
    """docs with one document of each group of near-duplicates, the one with the smallest id; the columns of docs.

    Where rows of a group share that id, those of one text stay. Rows without shingles stay. An empty table gives an empty result.
    """
    aside = {c: f"__own_{c}" for c in docs.columns if c.lower() in (*ADDED, "__node", "__one")}
    rows = docs.withColumnsRenamed(aside)
    judged = _judged(rows, text_col, id_col, words, percent, [id_col])
    gone = judged.where("not __one").select("__node", F.col(id_col).alias("__gone")).distinct()
    gone = materialise(gone, "gone")  # its size is then known before the texts move
    keyed = _nodes(rows, text_col)
    left = keyed.join(gone.withColumnRenamed("__node", "__n"), (F.col("__node") == F.col("__n")) & F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")
    return left.drop("__node").withColumnsRenamed({v: k for k, v in aside.items()}).select(*[f"`{c}`" for c in docs.columns])


def _nodes(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with __node, a number for each distinct text (A-Z lower-cased): a hash of 64 bits, unless two texts have the same."""
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    hashes = rows.select(F.xxhash64(text).alias("__node"), F.xxhash64(F.lit(1), text).alias("__other"))
    shared = hashes.groupBy("__node").agg(F.min("__other").alias("a"), F.max("__other").alias("b")).where("a <> b").select("__node", F.lit(True).alias("__shared"))
    shared = materialise(shared, "shared-hashes")  # next to none, and its size is known
    keyed = rows.withColumns({"__node": F.xxhash64(text), "__other": F.xxhash64(F.lit(1), text)}).join(shared, "__node", "left")
    return keyed.withColumn("__node", F.when(F.col("__shared"), F.xxhash64("__node", "__other")).otherwise(F.col("__node"))).drop("__other", "__shared")


def _judged(docs: DataFrame, text_col: str, id_col: str, words: int, percent: int, carry: list[str] | None) -> DataFrame:
    """What near_duplicates() returns, and __node, and in __one whether the row stays if one document of each group does."""
    rows = without(docs, [*ADDED, "__node", "__one", "__first", "__other", "__shared"])
    names = carry or rows.columns
    keyed = _nodes(rows, text_col)
    # Where only some columns are wanted, they are written with the node, so that the texts are not hashed again.
    ids = materialise(keyed.select(*[f"`{n}`" for n in names], "__node"), "ids") if carry and id_col in carry and text_col not in carry else None
    texts = keyed.select(F.col("__node").alias("node"), F.col(text_col).cast("binary").alias("text"))
    sketches = materialise(texts.mapInArrow(_sketch(words), "node long, n long, regs binary").dropDuplicates(["node"]), "sketches")

    bands = sketches.where("n > 0").mapInArrow(_bands, "key long, node long")
    centres = bands.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialise(bands.join(centres, "key").select("key", "node", "c", "size"), "buckets")
    wanted = shared.select("node").distinct()
    texts = materialise(texts.dropDuplicates(["node"]).join(wanted, "node", "left_semi"), "texts")

    a, b = (sketches.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("regs").alias(f"regs_{k}")) for k in "ab")
    text_a, text_b = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")

    def confirmed(pairs: DataFrame) -> DataFrame:
        hopeful = materialise(pairs.join(a, "a").join(b, "b").mapInArrow(_estimated(percent), "a long, b long"), "hopeful")
        return materialise(hopeful.join(text_a, "a").join(text_b, "b").mapInArrow(_verified(words, percent), "a long, b long"), "confirmed")

    firsts = shared.groupBy(F.col("node").alias("a")).agg(F.min("c").alias("c")).select("a", F.col("c.node").alias("b")).where("a <> b")
    tested = materialise(firsts, "firsts")
    links = confirmed(tested)
    labels = components(links)

    for turn in range(CENTRES):
        at = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))
        if turn:  # only in buckets that still hold several components
            held = shared.where("size > 2").select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            order = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")
            centre = held.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min(order).alias("c")).where("x <> y").select("key", F.col("c.node").alias("b"))
            pairs = held.select("key", F.col("node").alias("a")).join(centre, "key").select("a", "b")
        else:
            pairs = shared.select(F.col("node").alias("a"), F.col("c.node").alias("b"))
        apart = (
            pairs.where("a <> b").distinct().join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
            .select("a", "b").join(tested, ["a", "b"], "left_anti")
        )
        apart = materialise(apart, "apart")
        if apart.isEmpty():
            continue
        tested = tested.unionByName(apart)
        more = confirmed(apart)
        if not more.isEmpty():
            labels = with_links(labels, more)

    members = shared.where("size > 2").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sizes = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("largest"), F.sum("n").alias("size")).where("size > largest")
        .select("key", "main", F.ceil((F.col("size") - F.col("largest")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("size") / BLOCK).cast("int").alias("many"))
    )
    held = members.join(mixed, "key").join(sketches, "node").join(texts, "node").withColumn("h", F.xxhash64("node"))
    columns = ["key", "lo", "hi", "side", "node", "label", "n", "regs", "text"]
    other = held.where("label <> main").withColumns({"lo": F.pmod("h", F.col("few")).cast("int"), "hi": F.explode(F.sequence(F.lit(0), F.col("many") - 1)), "side": F.lit(0)}).select(columns)
    every = held.withColumns({"lo": F.explode(F.sequence(F.lit(0), F.col("few") - 1)), "hi": F.pmod("h", F.col("many")).cast("int"), "side": F.when(F.col("label") == F.col("main"), 2).otherwise(1)}).select(columns)
    dealt = other.unionByName(every)
    more = materialise(dealt.groupBy("key", "lo", "hi").applyInArrow(_within(words, percent), "a long, b long"), "rest")
    if not more.isEmpty():
        labels = with_links(labels, more)

    # The smallest id of each text, of each component, and then that of the component for each of its texts; rows come last, by text alone.
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__node").alias("node"))
    own = (ids or keyed).groupBy("__node").agg(F.min(rank).alias("first")).join(sketches.select(F.col("node").alias("__node"), "n"), "__node")
    linked = own.join(labels.withColumnRenamed("node", "__node"), "__node", "left")
    salt = F.pmod(F.xxhash64("__node"), F.lit(SALTS)).cast("int").alias("__salt")
    firsts = linked.where("label is not null").groupBy("label").agg(F.min("first").alias("__first")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    node = linked.select("__node", "n", "first", "label", salt).join(firsts, ["label", "__salt"], "left")
    node = materialise(node.select("__node", F.col("n").alias("n_shingles"), F.coalesce("__first", "first").alias("__first")), "nodes")
    alone = F.col("n_shingles") == 0
    same = F.col(id_col).eqNullSafe(F.col("__first.id"))
    return (
        (ids or keyed.select(*[f"`{n}`" for n in names], "__node")).join(node, "__node")
        .withColumn("component_id", F.when(alone, F.col(id_col)).otherwise(F.col("__first.id")))
        .withColumns({"kept": alone | same, "__one": alone | (same & (F.col("__node") == F.col("__first.node")))})
        .drop("__first")
    )
