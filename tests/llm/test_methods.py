"""What the dealt methods add to the fixed patterns, against plain versions, and inputs that are hard on them."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from stimframe.llm import html_text, pii, secrets
from stimframe.session import materialise

DIR = "/root/testdata/sf0.01"


def entropy(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def masked(m):
    """The candidate with the characters of placeholders blank, in turn."""
    for p in secrets.PLACEHOLDERS:
        m = re.sub(p, secrets.BLANK * len(p), m, flags=re.I)
    return m


def window_class(x):
    """Which class of CLASSES a window counts for, if it does."""
    digits = sum(c.isdigit() for c in x)
    if secrets.BLANK in x or not 0 < digits < len(x):
        return None
    return next(k for k, (own, _) in enumerate(secrets.CLASSES.values()) if not own or all(c in own for c in x))


def test_entropy_of_every_window(spark):
    g = random.Random(3)
    alphabets = ["ab12", "0123456789abcdef", "abcdefgh0123", secrets.ALPHABET, secrets.ALPHABET[26:62], "AB9", "9", "ab"]
    rows = [("".join("".join(g.choices(g.choice(alphabets), k=g.randint(5, 40))) for _ in range(g.randint(1, 3))).ljust(16, "a"),) for _ in range(1500)]
    codes = F.expr(f"struct(m, least(20, length(m)) as w, transform(split(m, ''), a -> instr('{secrets.ALPHABET + secrets.BLANK}', a) - 1) as codes)")
    for r in spark.createDataFrame(rows, "m string").withColumn("s", codes).withColumn("h", F.expr(secrets._highest_entropy(20))).collect():
        want = [None] * 4
        for i in range(max(1, len(r.m) - 19)):
            x = r.m[i : i + 20]
            if (k := window_class(x)) is not None:
                want[k] = max(want[k] or 0.0, entropy(x))
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(r.h, want)), (r.m, r.h, want)


def test_added_secrets_are_those_of_a_plain_version(spark):
    g = random.Random(4)
    letters = [secrets.ALPHABET[:62], "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "aaaaaaab1", "0123456789ABCDEF"]
    one = lambda: g.choice(["", "", "k=", "/v1/", "id_", "example-", "xXXx"]) + "".join(g.choices(g.choice(letters), k=g.randint(8, 50))) + g.choice(["", "", "0123456789", "Sample"])
    texts = [" ".join(one() for _ in range(12)) for _ in range(150)]
    classes = [n for _, n in secrets.CLASSES.values()]
    for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        want, base = [], [s[1:] for s in brute.spans(r.text, brute.SECRETS)]
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", r.text):
            w, x = min(20, len(m[0])), masked(m[0])
            windows = [x[i : i + w] for i in range(len(x) - w + 1)]
            hit = any((k := window_class(y)) is not None and entropy(y) >= secrets.least_entropy(classes[k], w) - 1e-12 for y in windows)
            if hit and not any(a < m.end() and m.start() < b for a, b in base) and not any(re.search(p.replace("++", "+").replace("*+", "*"), m[0]) for p in secrets.ALLOWED):
                want.append((m.start(), m.end()))
        assert [(s.start, s.stop) for s in r.added] == want, r.text


def test_keys_are_found_behind_names_and_paths(spark):
    g = random.Random(7)
    alphabets = {"hex": "0123456789ABCDEF", "caps": secrets.ALPHABET[:26] + "0123456789", "lower": secrets.ALPHABET[26:62], "mixed": secrets.ALPHABET[:62]}
    rows = [(f"{kind} {p}", f"see {p}{''.join(g.choices(own, k=32))} there") for kind, own in alphabets.items() for p in ("", "k=", "/v1/", "id_") for _ in range(200)]
    found = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id string, text string")).groupBy("doc_id").agg(F.avg((F.size("added") + F.size("base") > 0).cast("double")).alias("share")).collect()
    assert len(found) == 16 and all(r.share >= 0.95 for r in found), found


def test_long_candidates_take_time_in_proportion(spark):
    g = random.Random(5)
    blobs = [(k, "".join(g.choices(secrets.ALPHABET[:62], k=100_000))) for k in range(2, 7)]
    df = spark.createDataFrame([(0, f"see {''.join(g.choices(secrets.ALPHABET, k=1_000_000))} there"), (1, "1.2.3.4 deadbeefdeadbeef " * 20_000), *blobs], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert [(s.start, s.stop) for s in rows[0].added] == [(4, 1_000_004)] and rows[1].n_hex == 20_000 and time.time() - began < 90
    assert all([(s.start, s.stop) for s in rows[k].added] == [(0, 100_000)] or rows[k].base for k, _ in blobs)


def test_overlaps_by_bisection(spark):
    from stimframe.llm.spans import overlaps

    g = random.Random(6)
    rows = []
    for _ in range(300):
        at, spans = 0, []
        for _ in range(g.randint(0, 9)):
            at += g.randint(0, 5)
            spans.append((at, at := at + g.randint(1, 6)))
        a = g.randint(0, 40)
        rows.append((spans, (a, a + g.randint(1, 8))))
    df = spark.createDataFrame(rows, "x array<struct<start:int,stop:int>>, s struct<start:int,stop:int>")
    for r in df.withColumn("hit", F.expr(overlaps("x", "s"))).collect():
        assert r.hit == any(b.start < r.s.stop and r.s.start < b.stop for b in r.x)


def test_pii_adds_other_ways_of_writing(spark):
    """Recall and precision on the held-out fifth, whose labels don't come from the base patterns; numbers that their surroundings tell apart; and spans in the corpus."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = materialise(pii.find_candidates(docs, id_cols=["doc_id"]), "found")
    tried = materialise(pii.practised(found), "tried")
    model, limits = pii.fit_trees(found)
    at = "case kind " + " ".join(f"when '{k}' then {v}D" for k, v in limits.items()) + " else 2D end"
    rows = tried.where("held").withColumn("hit", pii.score(model, "x") >= F.expr(at)).collect()
    hits = [r for r in rows if r.hit]
    assert sum(r.y for r in hits) >= 0.95 * len(hits) and sum(r.y for r in hits) >= 0.75 * sum(r.y for r in rows)
    assert {r.of for r in rows if r.y} == set(pii.PATTERNS)
    weights = dict(zip(pii.FEATURES, model.featureImportances.toArray()))
    assert sum(v for k, v in weights.items() if k.startswith("says")) > 0.02 and weights["luhn"] > 0
    probes = ["invoice 555-010-9999 due", "call 555-010-9999 now", "from 12/05/2021 13/05/2021 on", "pi is 3.14159265358979 here", "mail bob (at) site (dot) org now"]
    seen = materialise(pii.find_candidates(spark.createDataFrame(list(enumerate(probes)), "doc_id int, text string"), id_cols=["doc_id"]), "probes").select("doc_id", F.explode("candidates").alias("c"))
    p = {}
    for r in seen.withColumn("p", pii.score(model, "c.x")).collect():
        p[r.doc_id] = max(p.get(r.doc_id, 0.0), r.p)
    assert p[1] > 0.7 and p[4] > 0.5 and max(p[0], p[2], p[3]) < 0.5
    added = pii.find_pii(docs, id_cols=["doc_id"]).select("doc_id", F.explode("added").alias("a")).select("doc_id", "a.*").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert added and all(texts[r.doc_id][r.start : r.stop] == r.m for r in added)
    for r in added:
        assert not any(a < r.stop and r.start < b for _, a, b in brute.spans(texts[r.doc_id], brute.PII))
        assert sum(o.doc_id == r.doc_id and o.start < r.stop and r.start < o.stop for o in added) == 1
    luhn = [brute.luhn(d) for r in added for d in re.findall("[0-9]+", r.m) if len(d) == 16]
    assert luhn and np.mean(luhn) > 0.8  # two numbers side by side, which the base pattern takes as one


def test_pii_adds_the_best_of_spans_that_overlap(spark, monkeypatch):
    """On nulls, repeated rows and ties, with trees that score by length and by digits."""
    text = "see 1.2.3.4.5.6.7.8.9 and (555) 010-9999, 0044207946 0958 or 12345678"
    df = spark.createDataFrame([(0, text), (0, text), (1, None), (2, "")], "doc_id long, text string")

    class Model:
        trees, treeWeights = [], []

    monkeypatch.setattr(pii, "fit_trees", lambda found, bound: (Model(), {k: 0.1 for k in pii.GENERATORS}))
    rows = pii.find_pii(df).collect()
    for r in rows:
        spans = [(s.start, s.stop) for s in r.added]
        assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert not r.text or all(r.text[s.start : s.stop] == s.m for s in r.added)
    # All score alike: the longer of two that overlap stays; the dotted number overlaps a base span.
    assert [[s.m for s in r.added] for r in rows if r.text] == [["(555) 010-9999", "0044207946 0958", "12345678"]] * 2
    assert [len(r.added) for r in rows if not r.text] == [0, 0]


def test_pii_generators_have_no_longest_candidate(spark):
    long = f"{'u' * 5000}@{'h' * 5000} " + "1.2" * 4000
    df = spark.createDataFrame([(0, long), (1, None)], "doc_id long, text string")
    kinds = {c.kind: c.stop - c.start for r in pii.find_candidates(df).collect() for c in r.candidates}
    assert kinds["wide_email"] == 10_001 and kinds["wide_number"] == kinds["wide_dotted"] == 12_000


def test_pii_trees_learn_from_every_span(spark):
    """More spans than a sample of 5,000 would hold, in texts with a number that isn't personal; the places of splits come from all rows too."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('write to u', id, '@site', id % 7, '.org about ', 20000000 + id) as text")
    found = materialise(pii.find_candidates(docs, id_cols=["doc_id"]), "found")
    rows = {r.template: r.n for r in pii.exercises(found).groupBy(F.expr("if(kind = 'decoy', kind, template)").alias("template")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = found.select(F.explode("candidates").alias("c")).count()
    assert n >= 12_000 and rows == {f"email-{k}": 6000 for k in range(len(pii.VARIANTS["email"]))} | {"decoy": n}
    rare = spark.range(0, 60_000, 1, 4).selectExpr("array(double(id = 31234)) as x", "double(id = 31234) as y")
    p = {r.x[0]: r.p for r in rare.distinct().withColumn("p", pii.score(pii._trees(rare, 5, 2), "x")).collect()}
    assert p[1.0] > 0.5 > p[0.0]


def test_pii_plans_each_pattern_few_times(spark):
    """The driver holds the plan of what the trees learn from: patterns don't stand in it once for each reader and part."""
    found = materialise(pii.find_candidates(spark.createDataFrame([(0, "mail a@b.org, call +1 555 010 9999")], "doc_id long, text string"), id_cols=["doc_id"]), "found")
    plan = pii.practised(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2 * len(pii.PATTERNS | pii.GENERATORS)


def test_redact(spark):
    df = spark.createDataFrame([(0, "mail a@b.org, c@d.org now", "x"), (1, None, "y"), (0, "mail a@b.org, c@d.org now", "x")], "doc_id long, text string, base string")
    assert sorted(map(tuple, pii.redact(df).collect()), key=str) == [(0, "mail [email], [email] now", "x"), (0, "mail [email], [email] now", "x"), (1, None, "y")]
    assert pii.redact(df.where("doc_id > 5")).count() == 0


SIX = [f"Paragraph {i}, with some words; and more of them." for i in range(6)]


@pytest.mark.parametrize("around", ["<div class='layout with sidebar'>", "<div class='elementor-widget'>", "<form id='aspnetForm'>", "<div class='post has-header'>", "<div class='node social-science'>"])
def test_html_wrappers_are_read_whatever_their_names(around):
    shut = f"</{around[1:].split()[0]}>"
    for before, after in (("", ""), ('<nav><a href="/">Home</a></nav>', "<footer>Us, here.</footer>")):
        assert html_text.main_text(f"{before}{around}{''.join(f'<p>{p}</p>' for p in SIX)}{shut}{after}") == " ".join(SIX)


def test_html_comments_longer_than_the_article_stay_out():
    body = "".join(f"<p>{p}</p>" for p in SIX)
    assert html_text.main_text(f"<div class='post'>{body}</div><div id='comments'>{body * 4}</div>") == " ".join(SIX)


def plain_page():
    """No element or name says what is what: menus, short notices, an article."""
    menu = "".join(f'<div><a href="/{i}">Entry {i}</a></div>' for i in range(12))
    notes = "".join(f"<span>Item {i}</span><br>" for i in range(12))
    return f"<div><div>{menu}</div><section>{''.join(f'<p>{p * 4}</p>' for p in SIX)}</section><div>{notes}</div></div>", " ".join(p * 4 for p in SIX)


def test_html_ratios_decide_where_no_name_does(monkeypatch):
    page, want = plain_page()
    assert html_text.main_text(page) == want
    monkeypatch.setattr(html_text, "ratios", lambda page, paths: np.ones(len(paths)))
    assert html_text.main_text(page) != want


def test_html_links_at_any_depth_are_links():
    page, want = plain_page()
    deep = page.replace(">Entry", ">" + "<b><i><u><em><span>" + "Entry")
    assert html_text.main_text(deep) == want


def test_html_takes_time_in_proportion():
    began = time.time()
    assert html_text.main_text("<div>" * 100_000 + "text, here.") == "text, here."
    for page in ("<div><p>text, x." * 50_000, "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 50_000 + "</p>" * 100_000, "<" + "a" * 200_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, '<a b="' * 50_000):
        html_text.main_text(page)
    assert time.time() - began < 5


def test_html_of_every_page_of_the_larger_table(spark):
    import html

    for r in html_text.extract_text(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)[^>]*>", article)]
        assert r.text == " ".join(p for p in parts if p)


def test_html_of_an_empty_table_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, plain_page()[0], "mine")] * 3, "page_id long, html string, n_chars string")
    assert {(r.text, r.n_chars) for r in html_text.extract_text(df).collect()} == {(plain_page()[1], len(plain_page()[1]))}
    assert html_text.extract_text(df.where("page_id > 1")).count() == 0


def test_quality_windows_by_words(spark):
    """The way taken where two windows of a text share a hash."""
    from stimframe.llm import quality_rules
    from stimframe.llm.common import words

    g = random.Random(9)
    texts = [" ".join(g.choices("abcd", k=g.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("__w", words(F.col("text"))).withColumn("n_words", F.size("__w").cast("long"))
    for r in df.withColumn("at", F.expr(quality_rules._BY_WORDS)).collect():
        w, at = r.text.split(), sorted(r.at)
        assert sum(min(3, b - a) for a, b in zip(at, [*at[1:], math.inf])) == brute.quality(r.text)[4], w


def test_documents_without_words_of_their_own_are_depleted(spark):
    from stimframe.llm.quality_rules import clean_documents, quality_rules

    line, own = " ".join(f"common{i}" for i in range(20)), lambda i, n: " ".join(f"u{i}x{k}" for k in range(n))
    rows = [(i, f"{line}\n{own(i, 60 if i % 2 else 45)}", "h", "mine") for i in range(20)] + [(20, None, None, "mine"), (21, own(21, 55), None, "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    judged = {r.doc_id: r for r in quality_rules(df).collect()}
    assert all((r.n_frequent_lines, r.depleted, r.kept) == (1, i % 2 == 0, i % 2 == 1) for i, r in judged.items() if i < 20)
    assert (judged[21].n_frequent_lines, judged[21].kept, judged[20].kept) == (0, True, False)
    left = clean_documents(df)
    assert left.columns == df.columns and {r.doc_id: (r.text, r.kept) for r in left.collect()} == {i: (own(i, 60 if i < 20 else 55), "mine") for i in (*range(1, 20, 2), 21)}
    assert clean_documents(df.where("doc_id > 99")).count() == 0


def test_mix_of_blocks_is_that_of_a_plain_version(spark):
    """Which rows are in the last epoch: those of the lowest places that fit, by a plain sum; with the plan broadcast and joined."""
    from stimframe.llm import mixing

    g = random.Random(10)
    rows = [(k, f"s{min(k % 7, 3)}", " ".join("w" * g.randint(1, 5) for _ in range(g.randint(0, 400)))) for k in range(1500)] + [(9999, "tied", "same row here")] * 41
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    totals = {}
    for _, source, text in rows:
        totals[source] = totals.get(source, 0) + max(1, len(text.split()))
    shares = {s.source: s for s in mixing.plan_mix(totals, 1.7)}
    keyed = df.select("doc_id", F.col("source").alias("__source"), F.xxhash64(F.lit(20), "doc_id", "text").alias("__k"), F.greatest(F.lit(1), F.size(F.split(F.trim("text"), " +"))).alias("n"), (F.length("text") == 0).alias("none"))
    plan = spark.createDataFrame([(s.source, s.blocks, math.floor(s.repeats)) for s in shares.values()], "__source string, __blocks long, __whole int")
    placed = keyed.join(plan, "__source").withColumn("place", mixing._place(20)).collect()
    want = Counter()
    for s in shares.values():
        left = (s.repeats - math.floor(s.repeats)) * s.tokens
        for r in sorted((r for r in placed if r["__source"] == s.source), key=lambda r: r.place):
            left -= 1 if r.none else r.n
            if left < 0:
                break
            want[r.doc_id] += 1
    for few in (100_000, 1):
        mixing.FEW_SOURCES, was = few, mixing.FEW_SOURCES
        try:
            got = Counter(r.doc_id for r in mixing.mix_sources(df, max_repeat=1.7).collect() if r.mix_epoch == math.floor(shares[r.source].repeats))
        finally:
            mixing.FEW_SOURCES = was
        assert got == want and got[9999] == 28


def test_mix_targets_that_cannot_be_met(spark):
    from stimframe.llm import mixing

    df = spark.createDataFrame([(k, f"s{k % 2}", "a b c") for k in range(10)], "doc_id long, source string, text string")
    for wanted in ({"max_repeat": 2.0, "budget_tokens": 150.0}, {"entropy": 5.0}):
        with pytest.raises(ValueError):
            mixing.mix_sources(df, **wanted)
    assert mixing.mix_sources(df, entropy=1.0).count() == 10
    with pytest.raises(ValueError):
        mixing.bisect_exponent([0.6, 0.4], entropy=5.0)


def test_dropping_exact_copies_of_groups_over_many_partitions(spark):
    from stimframe.llm.exact_dedup import drop_exact_duplicates

    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "Same").otherwise(F.concat(F.lit("same"), F.floor(F.col("id") / 7))).alias("text"))
    want = {}
    for r in df.collect():
        want.setdefault(r.text.lower(), []).append(r.doc_id)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keep, of in (("largest", max), ("smallest", min)):
            assert {r.text.lower(): r.doc_id for r in drop_exact_duplicates(df, keep=keep).collect()} == {t: of(ids) for t, ids in want.items()}
            assert drop_exact_duplicates(df, keep=keep).count() == len(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_language_learns_from_whole_texts(spark):
    from stimframe.llm import language_id

    rows = [("start " + "x" * 5000 + " ending", "en"), ("y" * 200_000, "en"), ("z" * 300_000, "fr"), ("v" * 200_000, "fr"), (None, "en"), ("only", None)]
    df = spark.createDataFrame(rows + rows, "text string, lang string")
    learned = language_id.learn_dictionaries(df)
    assert b"ending" in learned["en"] and b"y" not in learned["en"] and learned["fr"].strip() == b"v" * 200_000
    again = language_id.identify(df, learned).collect()
    assert len({(r.lang_pred, r.score) for r in again if r.text == "only"}) == 1
    assert [r.lang_pred for r in language_id.identify(spark.createDataFrame([("only",)], "text string"), {"de": b"abc", "en": b"abc"}).collect()] == ["de"]


def test_toxicity_of_repeated_rows_and_ties(spark):
    from stimframe.llm import toxicity

    docs = spark.createDataFrame([(k, "vile words here" if k % 2 else "kind words here") for k in range(200)] + [(1, "vile words here")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] * 2 + [(300, None)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(scored) == 203 and len({(r.text, r.score) for r in scored}) == 2 and all(r.predicted == ("vile" in r.text) for r in scored)


def test_pieces_of_empty_tables_and_clashing_names(spark):
    from stimframe.llm import sentencepiece_codec
    from stimframe.llm.queries import MODEL

    df = spark.createDataFrame([(1, "Some text", "mine"), (2, None, "mine"), (1, "Some text", "mine")], "doc_id long, text string, decoded string")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(df, MODEL), MODEL)
    assert sorted((r.doc_id, r.decoded) for r in back.collect()) == [(1, "Some text"), (1, "Some text"), (2, "")]
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(df.where("doc_id > 5"), MODEL), MODEL).count() == 0
    assert sentencepiece_codec.decode(spark.createDataFrame([(None,)], "ids array<int>"), MODEL).first().decoded is None


def test_stages_of_awkward_tables(spark):
    """Nulls in every column, copies, clashing names and an empty table go through every stage of the pipeline."""
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text, "en", "s", 1, "mine"), (1, text, "en", "s", 1, "mine"), (2, text.upper(), None, None, None, None), (None, text + " more", "en", "s", 1, "mine"), (4, None, None, None, None, None), (5, "", "en", "s", 0, "")]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string"), spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, kept string")):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = materialise(stage(spark, df, DIR), "stage")
            assert set(df.columns) <= set(out.columns), name
            df = out
        assert len({r.text for r in df.collect()}) <= 1


def near_classes(texts):
    """Smallest index of each text's component, by counting the shingles that every two texts share."""
    sets = [brute.shingles(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for own in holders.values() if len(own) > 1 for k, b in enumerate(own) for a in own[:k])
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], sets


def test_near_duplicates_of_the_whole_table_and_of_long_texts(spark):
    from stimframe.llm.minhash_dedup import near_duplicates

    g = random.Random(11)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()]
    for k in range(4):  # long texts, near copies on either side of the limit
        base = [f"w{g.randint(0, 9000)}" for _ in range(12_000)]
        for j in range(3):
            t = [w if g.random() > 0.015 * (j + 1) else f"n{g.randint(0, 9999)}" for w in base]
            rows.append((10**6 + 10 * k + j, " ".join(t)))
    classes, sets = near_classes([t for _, t in rows])
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for (i, _), c, s in zip(rows, classes, sets):
        assert (got[i].component_id, got[i].n_shingles, got[i].kept) == (rows[c][0] if s else i, len(s), not s or rows[c][0] == i)
    assert sum(rows[c][0] != i for (i, _), c in zip(rows, classes)) > 30


def test_texts_that_share_a_hash_are_different_nodes(spark, monkeypatch):
    from stimframe.llm import minhash_dedup

    whole = F.xxhash64
    monkeypatch.setattr(minhash_dedup.F, "xxhash64", lambda *c: F.pmod(whole(*c), F.lit(3)) if len(c) == 1 and "translate" in str(c[0]) else whole(*c))
    df = spark.createDataFrame([(k, f"text number {k % 20} of them") for k in range(40)], "doc_id long, text string")
    assert minhash_dedup._nodes(df, "text").select("__node").distinct().count() == 20


def test_links_are_found_in_blocks_of_any_size(spark, monkeypatch):
    """With few centres and small blocks, links of varied copies come from the blocks."""
    from stimframe.llm import minhash_dedup

    g = random.Random(12)
    texts = []
    for _ in range(8):
        base = [f"w{g.randint(0, 5000)}" for _ in range(g.randint(8, 200))]
        for _ in range(25):
            t = list(base)
            for _ in range(g.randint(0, max(1, len(t) // 30))):
                t[g.randrange(len(t))] = f"n{g.randint(0, 9999)}"
            texts.append(" ".join(t))
    classes, _ = near_classes(texts)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for rounds in (1, 3):
        monkeypatch.setattr(minhash_dedup, "CENTRES", rounds)
        assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()} == dict(enumerate(classes))


def test_components_after_more_links(spark):
    from stimframe.llm.components import components, with_links

    g = random.Random(13)
    pairs = [tuple(g.sample(range(400), 2)) for _ in range(260)]
    make = lambda rows: spark.createDataFrame(rows, "a long, b long")
    whole = sorted(map(tuple, components(make(pairs)).collect()))
    assert sorted(map(tuple, with_links(components(make(pairs[:150])), make(pairs[150:])).collect())) == whole
    assert sorted(map(tuple, with_links(components(make(pairs)), make([])).collect())) == whole
