"""Fingerprints, source divergence and importance resampling against plain versions, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stimframe.llm import divergence, fingerprints, resampling, toxicity
from stimframe.llm.queries import oracle_sql, queries
from stimframe.llm.shingles import WordHashes, shingle_set

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, code points of any width, clashing columns."""
    g = random.Random(11)
    words = ["".join(g.choices("abcdefgh", k=g.randint(2, 5))) for _ in range(60)] + ["Größe", "日本", "x9", "𝒳y", "É"]
    text = lambda n: " ".join(g.choices(words, k=n))
    base = text(70)
    rows = [(i, text(g.randint(0, 120)), g.choice(["en", "de", None]), f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, base, "en", "s0") for i in range(60)]  # a third of all rows are one text
    rows += [(300, None, None, None), (301, "", "en", "s9"), (302, "ab", "en", ""), (None, text(40), "en", "s1"), (None, text(40), "en", "s1"), (303, base.upper(), "en", "s1"), (303, "other", "zz", "s1"), (303, "other", "zz", "s1"), (304, "€" * 7, "yy", "a"), (305, " \t\n", "yy", "b"), (306, text(30_000), "en", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("score", "rank", "fingerprint", "n_chars", "weight", "term", "block", "kind"):
        df = df.withColumn(c, F.lit("mine"))
    return df.repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


# fingerprints


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def likeness(a, b):
    if not a and not b:
        return 1.0
    begin = common(a, b)
    end = min(common(a[::-1], b[::-1]), min(len(a), len(b)) - begin)
    return (begin + end) / max(len(a), len(b))


def plain_hash(text, h):
    out = []
    for base, p in zip(h.bases, fingerprints.PRIMES):
        out.append(sum((ord(c) + 1) * pow(base, i, p) for i, c in enumerate(text)) % p)
    return f"{len(text):x}-{out[0]:08x}{out[1]:08x}"


def check_fingerprints(rows, ordered):
    h = fingerprints.PrefixHashes()
    texts = [t or "" for t in ordered]
    want = Counter()
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        cut = len(t) - len(t) // 3
        edited = t[:cut] + after[: len(t) // 3]
        want[len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_hash(t, h), plain_hash(edited, h), round(likeness(t, edited), 9), round(likeness(t, after), 9)] += 1
    got = Counter((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)
    assert got == want


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_fingerprints_equal_a_plain_version(spark, docs, empty, partitions):
    # Of rows of one id (or none) the order is that of a hash; those here are told apart.
    own = docs.where("doc_id is not null and doc_id <> 303 and doc_id <> 306")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = fingerprints.fingerprint(own).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.score for r in rows} == {"mine"}
    check_fingerprints(rows, [r.text for r in sorted(own.collect(), key=lambda r: -r.doc_id)])
    assert fingerprints.fingerprint(empty).count() == 0


def test_fingerprints_of_awkward_rows(docs):
    rows = fingerprints.fingerprint(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next)) and all(r.near_edited >= 2 / 3 for r in rows)
    one = docs.where("doc_id = 301")
    assert [(r.near_edited, r.near_next, r.n_chars) for r in fingerprints.fingerprint(one).collect()] == [(1.0, 1.0, 0)]


def test_fingerprints_of_the_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries()["op11_fingerprints"](spark, "/root/testdata/sf0.01").collect()
    short = [r.text for r in sorted(d.collect(), key=lambda r: -r.doc_id)]
    assert len(rows) == len(short)
    texts = [t or "" for t in short]
    by = {r.doc_id: r for r in rows}
    for i, doc in enumerate(sorted(d.collect(), key=lambda r: -r.doc_id)):
        t, after, r = texts[i], texts[(i + 1) % len(texts)], by[doc.doc_id]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert np.isclose(r.near_edited, likeness(t, edited)) and np.isclose(r.near_next, likeness(t, after))


def test_spans_and_extensions(spark):
    g = random.Random(12)
    rows = []
    for _ in range(300):
        a, b = ("".join(g.choices("ab𝒳", k=g.randint(0, 40))) for _ in range(2))
        if g.random() < 0.5:
            b = a[g.randint(0, len(a)) :] + b
        rows.append((a, b, g.randint(0, 45), g.randint(0, 45), g.randint(-1, 12)))
    rows += [(None, "a", 0, 0, 0), ("a", "a", None, None, None), ("abc" * 40_000, "xabc" + "abc" * 40_000, 0, 1, 120_000)]
    df = spark.createDataFrame(rows, "a string, b string, i long, j long, n long").withColumn("forward", F.lit("mine"))
    got = fingerprints.common_extensions(df, "a", "b", "i", "j", "n").collect()
    assert len(got) == len(rows)
    for r in got:
        a, b = r.a or "", r.b or ""
        i, j = min(r.i or 0, len(a)), min(r.j or 0, len(b))
        assert r.forward == common(a[i:], b[j:]) and r.backward == common(a[:i][::-1], b[:j][::-1])
        assert r.equal == (None if r.n is None else r.n >= 0 and i + r.n <= len(a) and j + r.n <= len(b) and a[i : i + r.n] == b[j : j + r.n])
    assert fingerprints.common_extensions(df.where("n > 999999"), "a", "b", "i", "j").count() == 0


# divergence


def plain_divergence(rows, min_docs=3, top=200):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(t)), lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        docs, counts = Counter(), {}
        for terms, of, source in rows:
            if of == lang:
                docs.update(set(terms))
                counts.setdefault(source, Counter()).update(terms)
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        pairs = {(a, b): sum((ps[a][t] - ps[b][t]) ** 2 // ps[b][t] for t in kept) for a, b in permutations(counts, 2)}
        for s in counts:
            ranked = sorted(((-v, b.encode()) for (a, b), v in pairs.items() if a == s))
            out |= {(lang, s, "pair", b.decode(), -v, k + 1) for k, (v, b) in enumerate(ranked)}
            ranked = sorted((-((ps[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[s][t] and ps[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(ranked[:top])}
    return out


@pytest.mark.parametrize("top,cells,dense", [(200, divergence.CELLS, divergence.DENSE), (5, 8, 1)])
def test_divergence_equals_a_plain_version(docs, monkeypatch, top, cells, dense):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "DENSE", dense)
    rows = [tuple(r) for r in divergence.source_divergence(docs, top=top).collect()]
    assert len(set(rows)) == len(rows) and set(rows) == plain_divergence([(r.text, r.lang, r.source) for r in docs.collect()], top=top)


def test_divergence_flushes_its_counts(docs, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    assert {tuple(r) for r in divergence.source_divergence(docs).collect()} == plain_divergence([(r.text, r.lang, r.source) for r in docs.collect()])


def test_divergence_of_terms_with_one_vector(spark):
    """Many terms that occur alike: one vector, whose first terms alone are ranked."""
    many = " ".join(f"w{''.join(chr(97 + int(c)) for c in str(k))}" for k in range(1000))
    rows = [(many, "en", "a")] * 3 + [("other words here", "en", "b")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    vectors = divergence.count_vectors(divergence.term_counts(df)).collect()
    assert sorted(r.mult for r in vectors) == [3, 1000] and max(len(r.terms) for r in vectors) == 200
    assert {tuple(r) for r in divergence.source_divergence(df).collect()} == plain_divergence(rows)


def test_divergence_of_nothing(empty, docs):
    assert divergence.source_divergence(empty).count() == 0
    few = divergence.source_divergence(docs.where("doc_id in (304, 305)")).collect()
    assert sorted(map(tuple, few)) == [("yy", "a", "pair", "b", 0, 1), ("yy", "b", "pair", "a", 0, 1)]


def test_probabilities_are_exact():
    g = random.Random(13)
    counts = [g.randint(0, 10**k) for k in range(1, 15) for _ in range(40)]
    totals = [c + 1 + g.randint(0, 10 ** g.randint(0, 14)) for c in counts]
    got = divergence.probabilities(np.array(counts, np.int64), np.array(totals, np.int64))
    assert got.tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals)]


# resampling


def plain_resample(rows, target, percent=10, min_words=20, longest=1, buckets=10_000, seed=2024):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    scored = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        scored.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in scored if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0], r[3], r[2]))
    drawn = enough[: percent * len(enough) // 100]
    out = Counter((r[0], r[2], r[3], r[4], k + 1) for k, r in enumerate(drawn))
    rest = Counter((r[0], r[2], r[3], r[4], None) for r in scored)
    return out + (rest - Counter({(*k[:4], None): n for k, n in out.items()}))


@pytest.mark.parametrize("longest,percent,buckets,hot", [(1, 10, 10_000, 10_000), (2, 50, 70_000, 10), (1, 100, 7, 3)])
def test_resampling_equals_a_plain_version(spark, docs, monkeypatch, longest, percent, buckets, hot):
    monkeypatch.setattr(resampling, "HOT", hot)
    target = spark.createDataFrame([("abc x9 Größe",), (None,), ("cab ab fed",)] * 4, "text string")
    found = resampling.importance_resample(docs, target, percent=percent, longest=longest, buckets=buckets).collect()
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found)
    # Rows of one id with the same score but other texts differ in weight.
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent, 20, longest, buckets)
    assert got == want and {r.kind for r in found} == {"mine"}


def test_resampling_of_nothing(spark, docs, empty):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.importance_resample(empty, target).count() == 0
    none = resampling.importance_resample(docs, target.where("text = 'x'")).collect()
    assert len(none) == docs.count() and all(r.weight is not None for r in none)


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_resampling"])
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries()[name](spark, DIR)
    names = sorted(df.columns)
    found = duck.sql(oracle_sql()[name])
    assert names == sorted(found.columns)
    want = found.select(*[f'"{n}"' for n in names]).fetchall()
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, want))


# earlier operators


def test_labels_of_both_kinds_count_as_toxic(spark):
    """Whatever the order of the rows, and however often a labelled document comes."""
    from stimframe.llm.toxicity import fit_toxicity

    g = random.Random(14)
    good, bad = ["fine", "day", "sun", "tree"], ["vile", "scum", "hate", "rot"]
    docs = [(i, " ".join(g.choices(bad if i % 2 else good, k=12))) for i in range(120)]
    labels = [(i, i % 2) for i in range(120)] + [(1, 0), (3, 0), (None, 1), (5, None)]
    schema = "doc_id long, text string"
    fit = lambda d, l: fit_toxicity(spark.createDataFrame(d, schema), spark.createDataFrame(l, "doc_id long, toxic int"))
    want = fit(docs, labels)
    assert want and want == fit(docs[::-1] + docs[:50] * 3, labels[::-1]) and want == fit(docs, [x for x in labels if x not in ((1, 0), (3, 0))])
    assert fit([], labels) == {} == fit(docs, [])
    many = [(1, f"{' '.join(g.choices(bad, k=9))} {k}") for k in range(400)]
    few = fit_toxicity(spark.createDataFrame(docs + many, schema), spark.createDataFrame(labels, "doc_id long, toxic int"), bound=100)
    assert few  # of the 400 texts of one id about as many train as of all others


def test_copies_with_one_prefix_over_many_partitions(spark):
    """Texts that differ after the prefix, in groups that span partitions."""
    from stimframe.llm.exact_dedup import exact_dedup

    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a prefix of all of them "), (F.col("id") % 3).cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = exact_dedup(df, keep="largest").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.doc_id % 3, r.keep_id, r.group_size) for r in rows} == {(k, 2997 + k, 1000) for k in range(3)} and sum(r.kept for r in rows) == 3
    assert all(r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)


def test_pipeline_keeps_the_order_of_the_mix(spark, tmp_path):
    import corpus_pipeline
    from stimframe import session
    from stimframe.llm.mixing import mix_sources

    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("source in ('src1', 'src2', 'src3')")
    corpus_pipeline.mixed(spark, docs, DIR).write.parquet(str(tmp_path / "mix"))
    again = spark.read.parquet(str(tmp_path / "mix"))
    assert again.columns == docs.columns
    out = corpus_pipeline.pieces(spark, again, DIR).collect()
    at = {}
    for r in mix_sources(docs, max_repeat=1.5).collect():
        at.setdefault(r.doc_id, []).append(r.mix_at)
    placed = [r.doc_id for r in sorted(out, key=lambda r: r.mix_order)]
    seen, places = Counter(), []
    for i in placed:
        places.append(sorted(at[i])[seen[i]])
        seen[i] += 1
    assert places == sorted(places) and len({r.mix_order for r in out}) == len(out)
    assert sorted(map(str, out)) == sorted(map(str, corpus_pipeline.pieces(spark, spark.read.parquet(str(tmp_path / "mix")), DIR).collect()))
    twice = {}
    for r in out:
        twice.setdefault(r.doc_id, []).append(r.ids)
    long = [x for x in twice.values() if len(x) > 1 and len(x[0]) > 100]
    assert long and all(a != b for a, b in long)


def test_pipeline_of_one_text(spark, tmp_path):
    """Every row is one text; and the tables of the stages are gone but for the last."""
    import corpus_pipeline
    from stimframe import session

    words = " ".join(f"word{k} here." for k in range(60))
    spark.createDataFrame([(i, words, "en", "s", len(words)) for i in range(500)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    before = len(session._WRITTEN)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.text, r.lossless) for r in out] == [(499, words, True)]
    assert len(session._WRITTEN) == before + 1


def test_words_of_texts_without_spaces_are_not_kept():
    """A worker's cache of words has a bound in bytes, and what it doesn't keep hashes alike."""
    hashes, plain = WordHashes(), {}
    texts = [b"x%d" % k * 2000 for k in range(50)] + [b"a few words of %d, then one of some length: " % k + b"y" * (40 + k) for k in range(50)]
    for text in texts:
        assert (shingle_set(text, hashes) == shingle_set(text, WordHashes(longest=1 << 20))).all()
        plain |= {w: xxhash.xxh3_64_intdigest(w) for w in text.split()}
    assert sum(map(len, hashes)) < 5000 and hashes == {w: h for w, h in plain.items() if len(w) <= 64}
    kept = toxicity._Words(bound=100)
    for text in texts:
        toxicity.features(text, kept)
    assert len(kept) <= 102 and max(map(len, kept)) <= 64
