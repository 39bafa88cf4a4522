"""One query for each operator, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stimframe.llm import pii, secrets
from stimframe.llm.divergence import source_divergence
from stimframe.llm.exact_dedup import exact_dedup
from stimframe.llm.fingerprints import fingerprint
from stimframe.llm.html_text import extract_text
from stimframe.llm.language_id import held_out, identify, learn_dictionaries
from stimframe.llm.minhash_dedup import near_duplicates
from stimframe.llm.mixing import mix_sources
from stimframe.llm.quality_rules import quality_rules
from stimframe.llm.resampling import importance_resample
from stimframe.llm.sentencepiece_codec import encode
from stimframe.llm.toxicity import fit_toxicity, score_toxicity


#: The vocabulary file of the SentencePiece queries.
MODEL = os.environ.get("STIMFRAME_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed by temperature: no source more than twice, every document at least once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, max_repeat=2.0, carry=["doc_id", "source"])


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text with a tenth of the merges skipped, and whether they decode to the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, MODEL, dropout=0.1, carry=["doc_id"])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies by content sort; of equal texts the largest doc_id stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The text takes part in the sort as __norm; the result needs the id alone.
    return exact_dedup(docs, keep="largest", carry=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by fixed patterns and by boosted trees over candidates."""
    found = pii.find_pii(table(spark, sf_dir, "documents"), id_cols=["doc_id"])
    return pii.digest(found).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates by HyperMinHash, each link confirmed on full sets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, carry=["doc_id"]).select("doc_id", "n_shingles", "component_id", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by the smallest compressed size; documents with crc32 mod 4 = 2 are held out of what is learned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    learned = learn_dictionaries(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), learned).select("doc_id", "held_out", "lang_pred", "score", "narrow")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by tag-path ratios."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by fixed patterns and by the entropy of candidate strings."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secrets.digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; documents with crc32 mod 5 = 0 are held out of what is learned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 0))
    weights = fit_toxicity(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, weights).select("doc_id", "held_out", "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts within each text, and the verdict of line frequency by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "depleted", "n_frequent_lines")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint(docs, carry=["doc_id"])


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language, and the 200 telling terms of each source."""
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of at least 20 words, drawn by their likeness to the benchmark's words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resample(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_sentencepiece, op3_exact_dedup, op4_pii, op5_minhash_dedup, op6_language_id, op7_html_text, op8_secrets, op9_toxicity, op10_quality_rules, op11_fingerprints, op12_source_divergence, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": """
            WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
            FROM t WINDOW g AS (PARTITION BY text_sha256)""",
        "op10_quality_rules": r"""
            WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
            r AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) CROSS JOIN (VALUES (0), (1), (2)) AS k(o) WHERE n > 1 GROUP BY doc_id),
            x AS (SELECT DISTINCT host, t, lower(trim(line, E' \t\n\x0b\f\r')) AS line FROM (SELECT host, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE trim(line, E' \t\n\x0b\f\r') <> ''),
            f AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM x GROUP BY ALL) JOIN (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host) USING (host) WHERE n > 5 AND n > 0.01 * docs),
            z AS (SELECT x.host, t, sum(length(x.line)) AS total, sum(CASE WHEN f.line IS NULL THEN length(x.line) ELSE 0 END) AS own,
                    sum(CASE WHEN f.line IS NOT NULL THEN len(regexp_extract_all(x.line, '[^\x20\x09-\x0D]+')) ELSE 0 END) AS fewer, count(f.line) AS n_frequent_lines
                  FROM x LEFT JOIN f ON x.host = f.host AND x.line = f.line GROUP BY ALL),
            c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                    (len(list_filter(string_split(t, chr(10)), lambda l: trim(l, E' \t\n\x0b\f\r') <> '')) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: trim(l, E' \t\n\x0b\f\r') <> ''))))::BIGINT AS n_dup_lines,
                    coalesce(r.n, 0) AS n_repeat_words, coalesce(n_frequent_lines, 0) AS n_frequent_lines, coalesce(n_frequent_lines > 0 AND (own < 0.3 * total OR len(w) - fewer < 50), false) AS depleted
                  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN z USING (host, t))
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR depleted) AS kept FROM c""",
        "op12_source_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
            t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
            k AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL HAVING sum(docs) >= 3),
            g AS (SELECT DISTINCT lang, source FROM d),
            v AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
            c AS (SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n, k.n AS every FROM g JOIN k ON g.lang = k.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
            s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
            p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 1)) // (s.total + v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (c.every + 1)::HUGEINT) // (v.total + v.v)::HUGEINT AS q
                  FROM c JOIN s ON c.lang = s.lang AND c.source = s.source JOIN v ON c.lang = v.lang),
            pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
                  UNION ALL SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source JOIN v ON a.lang = v.lang WHERE v.v = 0),
            terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
            SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
            UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 200""",
        "op13_resampling": r"""
            WITH RECURSIVE x(i, k, c) AS (SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM x WHERE k < 8),
            tab AS (SELECT list(c ORDER BY i) AS t FROM x WHERE k = 8),
            d AS (SELECT 0 AS target, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
            w AS (SELECT target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
            f AS (SELECT target, doc_id, unnest(w) AS word FROM w),
            b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])), 4294967295) % 10000 AS bucket
                  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM f)), tab),
            n AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM f JOIN b USING (word) GROUP BY bucket),
            a AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM n),
            g AS (SELECT bucket, floor(1000 * ln((n.t::DOUBLE + 1) * (a.s + 10000) / ((n.s::DOUBLE + 1) * (a.t + 10000))))::BIGINT AS gain FROM n, a),
            m AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE target = 0 GROUP BY doc_id),
            e AS (SELECT w.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('2024:' || w.doc_id)[1:8])::BIGINT AS h FROM w LEFT JOIN m ON w.doc_id = m.doc_id WHERE target = 0),
            o AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
            r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 20)
            SELECT o.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM o LEFT JOIN r ON o.doc_id = r.doc_id""",
    }
