"""Queries over the driver's tables, one for each operator, and the DuckDB SQL of those that SQL expresses.

Doubles are rounded to six places on both sides, as sums come in another order, and 0.0 is added against negative zeros.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stimframe.operators import align, functionals, identity, models, stats, vectors
from stimframe.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("t", align.seconds("ts"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Events of a type numbered by id: a series for each type. Few types have most rows, so places come from a range partitioning."""
    from stimframe.operators.rank import ranked

    return ranked(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], [F.col("event_id")], "i")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events")
def align_sort(spark, d):
    return align.align_sort(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", F.col("pos").cast("long").alias("pos"))


@query("""
    WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events), p AS (SELECT user_id, event_id, t - 21600 AS s, t + 21600 AS e FROM e WHERE event_type = 'purchase')
    SELECT p.user_id, p.event_id, count(*) AS n_frames, round(avg(value), 6) + 0.0 AS pooled
    FROM p JOIN e ON p.user_id = e.user_id AND greatest(s, t - 3600) <= least(p.e, t) GROUP BY ALL""")
def overlap_pool(spark, d):
    """Mean value of a user's events, each lasting an hour, that touch six hours on either side of each purchase."""
    e = events(spark, d)
    spans = e.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("t") - 21600).alias("s"), (F.col("t") + 21600).alias("e"))
    pairs = align.overlap_join(spans, e.select("user_id", "t", "value"), "user_id", ("s", "e"), "t", frame_len=3600.0, bucket=43200.0)
    return rounded(align.mean_pool(pairs, ["user_id", "event_id"], "value"), "pooled")


@query("""
    WITH e AS (SELECT user_id, label_t, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS f, value FROM (SELECT *, epoch_us(ts) / 1e6 AS label_t FROM events)),
    p AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'purchase')
    SELECT p.user_id, p.event_id, round(avg(value), 6) + 0.0 AS m0, round(avg(value * value), 6) + 0.0 AS m1
    FROM p JOIN e ON p.user_id = e.user_id AND greatest(t - 21600, label_t - 0.025) <= least(t + 21600, label_t) GROUP BY ALL""")
def overlap_pool_vectors(spark, d):
    """The same with frames of 25 ms and two features."""
    e = events(spark, d).withColumn("x", F.array("value", F.col("value") * F.col("value")))
    spans = e.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("t") - 21600).alias("s"), (F.col("t") + 21600).alias("e"))
    pairs = align.overlap_join(spans, e.select("user_id", "t", "x"), "user_id", ("s", "e"), "t", bucket=43200.0)
    return align.mean_pool_vectors(pairs, ["user_id", "event_id"], "x").select("user_id", "event_id", r6(F.col("pooled")[0]).alias("m0"), r6(F.col("pooled")[1]).alias("m1"))


@query("""
    WITH w AS (SELECT event_type, value, unnest([epoch(ts)::BIGINT // 43200 * 43200, epoch(ts)::BIGINT // 43200 * 43200 - 43200]) AS w_start FROM (SELECT *, epoch_us(ts) // 1000000 AS q FROM events))
    SELECT event_type, w_start::BIGINT AS w_start, round(avg(value), 6) + 0.0 AS mean, count(*) AS n FROM (
        SELECT event_type, value, unnest([q // 43200 * 43200, q // 43200 * 43200 - 43200]) AS w_start FROM (SELECT *, epoch_us(ts) // 1000000 AS q FROM events)) GROUP BY ALL""")
def sliding_mean(spark, d):
    return rounded(align.sliding(table(spark, d, "events"), "ts", "24 hours", "12 hours", ["event_type"], "value"), "mean")


@query("""
    SELECT l_orderkey, unnest(range(1, least(greatest(n // 10, 1), 100) + 1)) * 10 AS s_end, greatest(s_end - 40, 0) AS s_start FROM (SELECT l_orderkey, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL)
    WHERE n >= 10 AND s_end <= n AND s_end >= 40""".replace("unnest(range(1, least(greatest(n // 10, 1), 100) + 1)) * 10 AS s_end, greatest(s_end - 40, 0) AS s_start FROM (SELECT l_orderkey, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL)\n    WHERE n >= 10 AND s_end <= n AND s_end >= 40", "e * 10 - 40 AS s_start, e * 10 AS s_end FROM (SELECT l_orderkey, n, unnest(range(4, n // 10 + 1)) AS e FROM (SELECT l_orderkey, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL))"))
def snippet_windows(spark, d):
    """Hops of 10 with a context of 30 over orders as stimuli of as many samples as pieces."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("n"))
    return n.select("l_orderkey", F.inline(align.snippets(F.col("n"), 10, 30))).select("l_orderkey", F.col("s_start").cast("long").alias("s_start"), F.col("s_end").cast("long").alias("s_end"))


@query("SELECT event_type AS token, (row_number() OVER (ORDER BY min(event_id)) - 1)::INTEGER AS idx FROM events GROUP BY event_type")
def vocab_first_seen(spark, d):
    return identity.build_vocabulary(table(spark, d, "events"), "event_type", ["event_id"])


@query("""
    WITH v AS (SELECT event_type AS token, (row_number() OVER (ORDER BY min(event_id)) - 1)::INTEGER AS idx FROM events WHERE event_type <> 'error' GROUP BY event_type)
    SELECT event_id, idx FROM events JOIN v ON event_type = token""")
def vocab_encode(spark, d):
    """Events whose type is in a vocabulary without one word."""
    e = table(spark, d, "events")
    return identity.encode_tokens(e, identity.build_vocabulary(e.where("event_type <> 'error'"), "event_type", ["event_id"]), "event_type").select("event_id", "idx")


@query(r"SELECT o_orderkey, trim(regexp_replace(upper(o_orderpriority), '^[0-9]+|[0-9]+$', '', 'g')) AS token FROM orders WHERE trim(regexp_replace(upper(o_orderpriority), '^[0-9]+|[0-9]+$', '', 'g')) NOT IN ('-LOW', 'SP', '')")
def token_normalize(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", identity.normalize_token(F.col("o_orderpriority")).alias("token"))
    return identity.drop_noise(o, "token", (*identity.NOISE, "-LOW"))


_Z = "(value - avg(value) OVER w) / (1e-10 + stddev_pop(value) OVER w)"


@query(f"SELECT event_id, round({_Z}, 6) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def zscore(spark, d):
    return rounded(vectors.zscore(table(spark, d, "events"), ["event_type"], "value").select("event_id", "z"), "z")


@query("""
    WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings)
    SELECT vec_id, dim::INTEGER AS dim, round((value - avg(value) OVER w) / (1e-10 + stddev_pop(value) OVER w), 6) + 0.0 AS z FROM x WINDOW w AS (PARTITION BY vec_id)""")
def zscore_by_row(spark, d):
    return rounded(vectors.zscore(vectors.exploded(table(spark, d, "embeddings"), ["vec_id"], "embedding"), ["vec_id"], "x").select("vec_id", "dim", "z"), "z")


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1)::DOUBLE AS rank FROM events")
def uniformize(spark, d):
    return vectors.uniformize(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value", "event_id").select("event_id", "rank")


@query()
def gaussianize(spark, d):
    return rounded(vectors.gaussianize(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value", "event_id").select("event_id", "gauss"), "gauss")


@query("SELECT event_id, round(least(greatest(value, avg(value) OVER w - 1.5 * stddev_pop(value) OVER w), avg(value) OVER w + 1.5 * stddev_pop(value) OVER w), 6) + 0.0 AS clipped FROM events WINDOW w AS (PARTITION BY event_type)")
def clip_sd(spark, d):
    return rounded(vectors.clip_sd(table(spark, d, "events"), ["event_type"], "value", 1.5).select("event_id", "clipped"), "clipped")


@query("""
    SELECT vec_id, (k - 1)::INTEGER AS dim, round((CASE WHEN k <= 64 THEN greatest(-embedding[k], 0) ELSE greatest(embedding[k - 64], 0) END)::DOUBLE, 6) + 0.0 AS x
    FROM (SELECT vec_id, embedding, unnest(range(1, 129)) AS k FROM embeddings)""")
def rectify(spark, d):
    return rounded(vectors.exploded(table(spark, d, "embeddings").select("vec_id", vectors.rectify(F.col("embedding")).alias("v")), ["vec_id"], "v"), "x")


@query("""
    SELECT vec_id, (generate_subscripts(v, 1) - 1)::INTEGER AS dim, round(unnest(v)::DOUBLE, 6) + 0.0 AS x FROM (SELECT vec_id, list_concat(embedding[1:12], embedding[14:64]) AS v FROM embeddings)""")
def drop_channel(spark, d):
    return rounded(vectors.exploded(table(spark, d, "embeddings").select("vec_id", vectors.drop_channel(F.col("embedding"), 12, 63).alias("v")), ["vec_id"], "v"), "x")


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS top FROM embeddings")
def argmax_target(spark, d):
    return table(spark, d, "embeddings").select("vec_id", identity.argmax(F.col("embedding")).alias("top"))


@query("""
    WITH a AS (SELECT *, [event_type, CASE WHEN value > 10 THEN 'high' ELSE 'low' END] AS attrs FROM events)
    SELECT event_id, k.v AS attr, list_contains(attrs, k.v)::INTEGER AS hot FROM a, (VALUES ('click'), ('purchase'), ('high'), ('absent')) AS k(v)""")
def multi_hot(spark, d):
    names = ["click", "purchase", "high", "absent"]
    a = table(spark, d, "events").withColumn("attrs", F.array("event_type", F.when(F.col("value") > 10, "high").otherwise("low")))
    return a.select("event_id", F.posexplode(identity.multi_hot(F.col("attrs"), names)).alias("k", "hot")).select("event_id", F.lit(names)[F.col("k")].alias("attr"), "hot")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'pointer' WHEN 'view' THEN 'screen' ELSE '' END AS attr FROM events")
def attribute_lookup(spark, d):
    """Dictionary of attributes; tokens that it lacks have one empty attribute."""
    known = spark.createDataFrame([("click", ["pointer"]), ("view", ["screen"])], "token string, attrs array<string>")
    return identity.attributes_of(table(spark, d, "events"), known, "event_type").select("event_id", F.explode("attrs").alias("attr"))


@query("SELECT 'quality' AS target, sum(quality)::DOUBLE AS total, coalesce(sum(quality) > 0, false) AS kept FROM labels UNION ALL SELECT 'toxic', sum(toxic)::DOUBLE, coalesce(sum(toxic) > 0, false) FROM labels UNION ALL SELECT 'never', 0.0, false")
def nonzero_columns(spark, d):
    return identity.nonzero_columns(table(spark, d, "labels").withColumn("never", F.lit(0)), ["quality", "toxic", "never"])


@query(r"SELECT url, string_split(regexp_replace(list_extract(string_split(url, '/'), -1), '\.[^.]*$', ''), '_')[1] AS stim, count(*) AS n FROM pages GROUP BY ALL")
def name_key(spark, d):
    return table(spark, d, "pages").groupBy("url").agg(F.count(F.lit(1)).alias("n")).select("url", identity.name_key(F.col("url")).alias("stim"), "n")


@query(r"SELECT page_id, list_extract(string_split(url, '/'), -2) AS section, list_extract(string_split(url, '/'), 3) AS host FROM pages WHERE NOT contains(url, '.html')")
def path_dimensions(spark, d):
    """Dimensions by place from either end of a path, of the paths without a substring."""
    u = F.col("url")
    return table(spark, d, "pages").where(~F.contains(u, F.lit(".html"))).select("page_id", identity.path_part(u, -2).alias("section"), identity.path_part(u, 3).alias("host"))


@query("SELECT (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id)) AS n_both, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS n_left_only, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS n_right_only")
def key_completeness(spark, d):
    return identity.key_completeness(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT event_id, user_id FROM events SEMI JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) ON user_id = c_custkey")
def split_semi(spark, d):
    roles = table(spark, d, "customer").select(F.lit(0).alias("split"), F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 5 != 0, "train").otherwise("test").alias("role"))
    return models.take_role(table(spark, d, "events"), roles, "user_id", 0, "train").select("event_id", "user_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def done_anti(spark, d):
    """Work list: documents without a result."""
    return files.missing_work(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT user_id, (sum(n) OVER (ORDER BY user_id) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY user_id))::BIGINT AS stop FROM (SELECT user_id, count(*) AS n FROM events GROUP BY ALL)")
def row_offsets(spark, d):
    return align.row_offsets(table(spark, d, "events"), "user_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back FROM events) WHERE back % 5 = 0 AND back < 15")
def frame_select(spark, d):
    return align.select_frames(table(spark, d, "events"), "user_id", ["ts", "event_id"], 3, 5).select("user_id", "event_id")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_PRED = "1500 * l_quantity"


@query(f"SELECT l_returnflag, l_linestatus, round(1 - avg(({_PRED} - l_extendedprice) ** 2) / var_pop(l_extendedprice), 6) + 0.0 AS r2, round(sqrt(avg(({_PRED} - l_extendedprice) ** 2)), 6) + 0.0 AS rmse FROM lineitem GROUP BY ALL")
def r2_rmse(spark, d):
    return rounded(stats.r2_rmse(table(spark, d, "lineitem").withColumn("pred", F.expr(_PRED)), ["l_returnflag", "l_linestatus"], "l_extendedprice", "pred"), "r2", "rmse")


@query("""
    WITH c AS (SELECT quality AS t, toxic AS p FROM labels), k AS (SELECT t AS class FROM c UNION SELECT p FROM c)
    SELECT class, count(*) FILTER (t = class) AS support, round(count(*) FILTER (t = class AND p = class) / nullif(count(*) FILTER (p = class), 0), 6) + 0.0 AS precision,
        round(count(*) FILTER (t = class AND p = class) / nullif(count(*) FILTER (t = class), 0), 6) + 0.0 AS recall,
        round(2 * count(*) FILTER (t = class AND p = class) / nullif(count(*) FILTER (t = class) + count(*) FILTER (p = class), 0), 6) + 0.0 AS f1 FROM k, c GROUP BY class""")
def class_recall(spark, d):
    return rounded(stats.class_metrics(table(spark, d, "labels"), "quality", "toxic"), "precision", "recall", "f1")


@query("""
    WITH c AS (SELECT quality AS t, toxic AS p FROM labels), k AS (SELECT DISTINCT t AS class FROM c),
    m AS (SELECT class, count(*) FILTER (t = class AND p = class) AS hit, count(*) FILTER (t = class) AS is_, count(*) FILTER (p = class) AS said FROM k, c GROUP BY class)
    SELECT round(sum(hit) / sum(is_), 6) + 0.0 AS accuracy, round(avg(hit / is_), 6) + 0.0 AS balanced_accuracy, round(avg(coalesce(hit / nullif(said, 0), 0)), 6) + 0.0 AS precision,
        round(avg(hit / is_), 6) + 0.0 AS recall, round(avg(2 * hit / (is_ + said)), 6) + 0.0 AS f1 FROM m""")
def class_summary(spark, d):
    return rounded(stats.class_summary(table(spark, d, "labels"), "quality", "toxic"), "accuracy", "balanced_accuracy", "precision", "recall", "f1")


@query("""
    WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS a, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS b FROM embeddings)
    SELECT dim::INTEGER AS dim, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) + 0.0 AS corr FROM x GROUP BY dim""")
def corr_by_feature(spark, d):
    """Correlation of every dimension with the first, over rows."""
    e = table(spark, d, "embeddings").withColumn("a", F.col("embedding")[0].cast("double"))
    return rounded(stats.corr_by_feature(vectors.exploded(e, ["vec_id", "a"], "embedding"), [], ["dim"], "a", "x"), "corr")


@query("""
    WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS b, unnest(list_reverse(embedding))::DOUBLE AS a FROM embeddings)
    SELECT vec_id, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) + 0.0 AS corr FROM x GROUP BY vec_id""")
def corr_by_row(spark, d):
    """Correlation of each row with itself reversed, over dimensions."""
    e = table(spark, d, "embeddings").select("vec_id", F.explode(F.arrays_zip(F.col("embedding").alias("b"), F.reverse("embedding").alias("a"))).alias("p")).select("vec_id", F.col("p")["b"].cast("double").alias("x"), F.col("p")["a"].cast("double").alias("a"))
    return rounded(stats.corr_by_feature(e, [], ["vec_id"], "a", "x"), "corr")


@query("SELECT event_type, user_id::VARCHAR AS user_id, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY GROUPING SETS ((event_type, user_id), (event_type))")
def pooled_eval(spark, d):
    return rounded(stats.pooled_eval(table(spark, d, "events"), "event_type", "user_id", "value").withColumn("user_id", F.col("user_id").cast("string")), "mean")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd FROM events GROUP BY event_type")
def group_summary(spark, d):
    return rounded(stats.group_summary(table(spark, d, "events"), ["event_type"], "value"), "mean", "sd")


@query("""
    WITH m AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY ALL), s AS (SELECT sum((n - 1) * v) / sum(n - 1) AS s2, sum(n - 1)::BIGINT AS df FROM m)
    SELECT a.g AS group1, b.g AS group2, round((a.m - b.m) / sqrt(s2 * (1 / a.n + 1 / b.n)), 6) + 0.0 AS t, df FROM m a JOIN m b ON a.g < b.g, s""")
def pooled_t(spark, d):
    return rounded(stats.pairwise_t(table(spark, d, "events"), "event_type", "value"), "t")


@query()
def pairwise_p(spark, d):
    return rounded(stats.pairwise_p(table(spark, d, "events"), "event_type", "value"), "t", "p", "p_adj")


@query("""
    WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY ALL)
    SELECT event_type, round(q1, 6) + 0.0 AS q1, round(q2, 6) + 0.0 AS q2, round(q3, 6) + 0.0 AS q3, round(min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) + 0.0 AS whisker_low,
        round(max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) + 0.0 AS whisker_high, count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM events JOIN q USING (event_type) GROUP BY event_type, q1, q2, q3""")
def boxplot(spark, d):
    return rounded(stats.boxplot(table(spark, d, "events"), ["event_type"], "value"), "q1", "q2", "q3", "whisker_low", "whisker_high")


@query("SELECT doc_id, 'quality' AS metric, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def unpivot_metrics(spark, d):
    return table(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "metric", "value")


@query(r"SELECT part.p_partkey, regexp_extract(p_brand, '^(.*?)[0-9]*$', 1) AS name, nullif(regexp_extract(p_brand, '([0-9]*)$', 1), '')::INTEGER AS n FROM part")
def metric_names(spark, d):
    """Names split from their trailing numbers."""
    name, n = stats.split_metric(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), n.alias("n"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE event_type END AS event_type FROM events")
def recode(spark, d):
    return stats.recode(table(spark, d, "events").select("event_id", "event_type"), ["event_type"], {"click": "tap", "view": "look"})


@query("SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT event_id, round(sqrt(value - 10), 6) + 0.0 AS root FROM events WHERE value >= 10")
def nan_drop(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("value") >= 10, F.sqrt(F.abs(F.col("value") - 10))).otherwise(F.lit(float("nan"))).alias("root"))
    return rounded(stats.drop_nan(e, ["root"]), "root")


_SERIES = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0.0 AS smooth FROM {_SERIES}")
def moving_avg3(spark, d):
    return rounded(functionals.moving_average(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "smooth"), "smooth")


@query(f"""
    WITH z AS (SELECT *, CASE WHEN event_type = 'view' THEN 0 ELSE value END AS v FROM {_SERIES})
    SELECT event_id, round(CASE WHEN v = 0 THEN 0 ELSE avg(nullif(v, 0)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 6) + 0.0 AS smooth FROM z""")
def moving_avg3_nonzero(spark, d):
    z = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value")))
    return rounded(functionals.moving_average(z, ["user_id"], ["ts", "event_id"], "v", no_zero=True).select("event_id", "smooth"), "smooth")


@query(f"""
    SELECT event_id, round((1 * (lead(value, 1, last_) OVER w - lag(value, 1, first_) OVER w) + 2 * (lead(value, 2, last_) OVER w - lag(value, 2, first_) OVER w)) / 10, 6) + 0.0 AS delta
    FROM (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY i) AS first_, last_value(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_ FROM {_SERIES})
    WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def delta_regression(spark, d):
    return rounded(functionals.delta(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "delta"), "delta")


_RUNS = f"""WITH f AS (SELECT *, value > 10 AS "on" FROM {_SERIES}), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, "on" ORDER BY i) AS run FROM f),
    s AS (SELECT user_id, "on", run, min(epoch_us(ts))::BIGINT AS start, count(*) AS length FROM g GROUP BY ALL)"""


def _runs(spark, d):
    e = table(spark, d, "events").withColumn("us", align.micros("ts"))
    return functionals.segments(e, ["user_id"], ["us", "event_id"], F.col("value") > 10)


@query(_RUNS + ' SELECT user_id, "on", start, length FROM s')
def segments(spark, d):
    return _runs(spark, d)


@query(_RUNS + ' SELECT user_id, count(*) AS n_segments, round(avg(length), 6) + 0.0 AS mean_length, max(length) AS max_length, min(length) AS min_length, round(stddev_pop(length), 6) + 0.0 AS sd_length FROM s WHERE "on" GROUP BY user_id')
def segment_lengths(spark, d):
    return rounded(functionals.segment_summary(_runs(spark, d), ["user_id"]), "mean_length", "sd_length")


@query("""
    SELECT event_type, round(avg(value), 6) + 0.0 AS amean, round(avg(value) FILTER (value > 0), 6) + 0.0 AS posamean, round(sqrt(avg(value * value)), 6) + 0.0 AS rqmean,
        round(exp(avg(ln(abs(value))) FILTER (value <> 0)) / avg(abs(value)) FILTER (value <> 0), 6) + 0.0 AS flatness, count(*) FILTER (value <> 0) AS nnz FROM (SELECT event_type, nullif(value, 0) AS nz, value FROM events) GROUP BY event_type""".replace("avg(ln(abs(value))) FILTER (value <> 0)", "avg(ln(abs(nz)))"))
def functionals_means(spark, d):
    return rounded(functionals.means(table(spark, d, "events"), ["event_type"], "value"), "amean", "posamean", "rqmean", "flatness")


@query("""
    WITH m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY ALL)
    SELECT event_type, round(any_value(m), 6) + 0.0 AS mean, round(any_value(s), 6) + 0.0 AS sd, round(any_value(s) / abs(any_value(m)), 6) + 0.0 AS sd_norm, round(avg(((value - m) / s) ** 3), 6) + 0.0 AS skew, round(avg(((value - m) / s) ** 4), 6) + 0.0 AS kurt
    FROM events JOIN m USING (event_type) GROUP BY event_type""")
def skew_kurt(spark, d):
    return rounded(functionals.moments(table(spark, d, "events"), ["event_type"], "value"), "mean", "sd", "sd_norm", "skew", "kurt")


_Q = ", ".join(f"round(quantile_cont(value, {q}), 6) + 0.0 AS p{round(q * 100)}" for q in (0.01, 0.2, 0.25, 0.5, 0.75, 0.8, 0.99))


@query(f"SELECT event_type, {_Q}, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) + 0.0 AS iqr, round(quantile_cont(value, 0.99) - quantile_cont(value, 0.01), 6) + 0.0 AS range FROM events GROUP BY event_type")
def functionals_percentiles(spark, d):
    return rounded(functionals.percentiles(table(spark, d, "events"), ["event_type"], "value"), "p1", "p20", "p25", "p50", "p75", "p80", "p99", "iqr", "range")


_I = "(SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events)"


@query(f"""
    SELECT event_type, round(regr_slope(value, i), 6) + 0.0 AS slope, round(regr_intercept(value, i), 6) + 0.0 AS "offset", round((regr_syy(value, i) - regr_sxy(value, i) ** 2 / regr_sxx(value, i)) / count(*), 6) + 0.0 AS error,
        round(sum(i * abs(value)) / sum(abs(value)), 6) + 0.0 AS centroid FROM {_I} GROUP BY event_type""")
def functionals_core(spark, d):
    """Line and centroid of each type's series."""
    return rounded(functionals.regression(placed(spark, d), ["event_type"], "i", "value"), "slope", "offset", "error", "centroid")


@query(f"""
    WITH c AS (SELECT event_type, value, avg(i) OVER w AS m, i - avg(i) OVER w AS t FROM {_I} WINDOW w AS (PARTITION BY event_type)),
    s AS (SELECT event_type, count(*) AS n, sum(t * t) AS s2, sum(t * t * t) AS s3, avg(value) AS y, sum(t * value) AS y1 FROM c GROUP BY event_type),
    p AS (SELECT event_type, any_value(m) AS m, any_value(s2) AS s2, any_value(s3) AS s3, any_value(n) AS n, any_value(y) AS y, any_value(y1) AS y1, sum((t * t - s3 / s2 * t - s2 / n) * value) / sum((t * t - s3 / s2 * t - s2 / n) ** 2) AS a FROM c JOIN s USING (event_type) GROUP BY event_type),
    k AS (SELECT event_type, m, a, y1 / s2 - a * s3 / s2 AS b, y - a * s2 / n AS c FROM p)
    SELECT event_type, round(a * 1e6, 6) + 0.0 AS qa, round((b - 2 * a * m) * 1e3, 6) + 0.0 AS qb, round(a * m * m - b * m + c, 6) + 0.0 AS qc FROM k""")
def functionals_quadratic(spark, d):
    return rounded(functionals.quadratic(placed(spark, d), ["event_type"], "i", "value").withColumn("qa", F.col("qa") * 1e6).withColumn("qb", F.col("qb") * 1e3), "qa", "qb", "qc")


@query(f"""
    SELECT event_type, round(arg_max(i, struct_pack(v := value, k := -i)) / count(*), 6) + 0.0 AS max_pos, round(arg_min(i, struct_pack(v := value, k := i)) / count(*), 6) + 0.0 AS min_pos FROM {_I} GROUP BY event_type""")
def extreme_pos(spark, d):
    return rounded(functionals.extremes(placed(spark, d), ["event_type"], "i", "value"), "max_pos", "min_pos")


@query("""
    WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL)
    SELECT event_type, """ + ", ".join(f"round(avg(CASE WHEN value > lo + {q} * (hi - lo) THEN 1 ELSE 0 END), 6) + 0.0 AS up{round(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9)) + " FROM events JOIN r USING (event_type) GROUP BY event_type")
def uplevel_time(spark, d):
    return rounded(functionals.level_times(table(spark, d, "events"), ["event_type"], "value"), "up25", "up50", "up75", "up90")


@query(f"""
    WITH s AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY i) AS dv FROM {_SERIES}), t AS (SELECT *, dv - lag(dv) OVER (PARTITION BY user_id ORDER BY i) AS ddv FROM s)
    SELECT user_id, round(avg((dv > 0)::INTEGER), 6) + 0.0 AS rise, round(avg((ddv > 0)::INTEGER), 6) + 0.0 AS left_curve FROM t GROUP BY user_id""")
def rise_times(spark, d):
    return rounded(functionals.rise_times(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value"), "rise", "left_curve")


@query(f"""
    WITH m AS (SELECT user_id, avg(value) AS m, max(value) - min(value) AS r FROM events GROUP BY ALL),
    p AS (SELECT *, value > lag(value) OVER w AND value >= lead(value) OVER w AS top FROM {_SERIES} WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    k AS (SELECT user_id, i, value - m AS h, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS gap FROM p JOIN m USING (user_id) WHERE top AND value - m > 0.1 * r)
    SELECT user_id, count(*) AS n_peaks, round(avg(gap), 6) + 0.0 AS mean_distance, round(avg(h), 6) + 0.0 AS mean_height FROM k GROUP BY user_id""")
def peaks(spark, d):
    return rounded(functionals.peaks(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value"), "mean_distance", "mean_height")


@query(f"SELECT user_id, " + ", ".join(f"round(sum(value * l{k}), 6) + 0.0 AS r{k}" for k in range(3)) + f" FROM (SELECT *, value AS l0, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2 FROM {_SERIES} WINDOW w AS (PARTITION BY user_id ORDER BY i)) GROUP BY user_id")
def autocorrelation(spark, d):
    return rounded(functionals.autocorrelation(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 2), "r0", "r1", "r2")


@query("SELECT event_type, round(10 * log10(avg(value * value)), 6) + 0.0 AS level FROM events GROUP BY event_type")
def sound_level(spark, d):
    return rounded(functionals.sound_level(table(spark, d, "events").withColumn("e", F.col("value") * F.col("value")), ["event_type"], "e"), "level")


@query("SELECT label, dim::INTEGER AS dim, round(avg(x), 6) + 0.0 AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def mean_vector(spark, d):
    return rounded(vectors.mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "mean")


_CORR = """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
    x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, unnest((SELECT e FROM q))::DOUBLE AS b FROM embeddings),
    s AS (SELECT vec_id, coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0) AS score FROM x GROUP BY vec_id)"""


@query(_CORR + " SELECT vec_id, round(score, 6) + 0.0 AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def topk_similar(spark, d):
    return rounded(vectors.top_similar_to(table(spark, d, "embeddings"), "vec_id", "embedding", 0), "score")


@query("""
    WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id < 5), x AS (SELECT query, embeddings.vec_id, unnest(embedding)::DOUBLE AS a, unnest(e)::DOUBLE AS b FROM embeddings, q),
    s AS (SELECT query, vec_id, coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0) AS score FROM x GROUP BY ALL)
    SELECT query::INTEGER AS query, vec_id, r::INTEGER AS r, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def topk_batch(spark, d):
    """Top 10 for each of five query vectors."""
    e = table(spark, d, "embeddings")
    q = {int(r.vec_id): list(r.embedding) for r in e.where("vec_id < 5").collect()}
    return rounded(vectors.top_similar_batch(e, "vec_id", "embedding", q, 10), "score").select("query", "vec_id", "r", "score")


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), c AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS v FROM e),
    u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM c),
    s AS (SELECT q.vec_id AS query, u.vec_id, round(list_inner_product(q.v, u.v), 12) + 0.0 AS score FROM u AS q JOIN u ON q.vec_id % 20 = 0)
    SELECT query, vec_id, r, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INTEGER AS r FROM s) WHERE r <= 10""")
def topk_batch_all(spark, d):
    """Top 10 for every vector whose id is divisible by 20; topk_batch has five queries, as its SQL fixes."""
    e = table(spark, d, "embeddings")
    return rounded(vectors.top_similar_blocks(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), 10), "score").select("query", "vec_id", "r", "score")


@query("SELECT * FROM (SELECT vec_id, round(embedding[4]::DOUBLE, 6) + 0.0 AS score, 'best' AS side FROM embeddings ORDER BY embedding[4] DESC, vec_id LIMIT 5) UNION ALL SELECT * FROM (SELECT vec_id, round(embedding[4]::DOUBLE, 6) + 0.0, 'worst' FROM embeddings ORDER BY embedding[4], vec_id LIMIT 5)")
def best_worst(spark, d):
    return rounded(vectors.best_worst(table(spark, d, "embeddings"), "vec_id", F.col("embedding")[3].cast("double"), 5), "score")


@query("SELECT vec_id FROM (SELECT vec_id, count(*) OVER () - (row_number() OVER (ORDER BY embedding[1], vec_id) - 1) AS k FROM embeddings) WHERE k > 20 AND k < 360")
def rank_band(spark, d):
    return vectors.rank_band(table(spark, d, "embeddings"), "vec_id", "embedding", 20, 360)


@query()
def diverse_topk(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(vectors.diverse_top(e, "vec_id", "embedding", list(e.where("vec_id = 0").first().embedding), 5, 10), "score")


@query("""
    WITH w AS (SELECT label AS word, embedding FROM embeddings WHERE vec_id < 10 QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1), s AS (SELECT user_id, event_id % 12 AS word FROM events)
    SELECT user_id, dim::INTEGER AS dim, round(avg(x), 6) + 0.0 AS mean, count(*) AS n FROM (SELECT user_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM s JOIN w USING (word)) GROUP BY ALL""")
def bag_of_words(spark, d):
    """Mean vector of the known words of each user's sequence; unknown words don't count."""
    w = table(spark, d, "embeddings").where("vec_id < 10").groupBy(F.col("label").alias("word")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    s = table(spark, d, "events").select("user_id", (F.col("event_id") % 12).cast("int").alias("word"))
    return rounded(vectors.bag_of_words(s, "user_id", "word", w, "word", "embedding"), "mean")


@query("""
    WITH w AS (SELECT label AS word, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1), s AS (SELECT user_id, event_id % 12 AS word FROM events)
    SELECT user_id, dim::INTEGER AS dim, round(avg(x), 6) + 0.0 AS mean, count(*) AS n FROM (SELECT user_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM s JOIN w USING (word)) GROUP BY ALL""")
def bag_of_words_all(spark, d):
    """As bag_of_words, with the labels of all vectors as the vocabulary; bag_of_words takes those of ten, as its SQL fixes."""
    w = table(spark, d, "embeddings").groupBy(F.col("label").alias("word")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    s = table(spark, d, "events").select("user_id", (F.col("event_id") % 12).cast("int").alias("word"))
    return rounded(vectors.bag_of_words(s, "user_id", "word", w, "word", "embedding"), "mean")


@query("""
    SELECT l_returnflag, round((sum(a * y) * sum(b * b) - sum(b * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) ** 2), 6) + 0.0 AS w0, round((sum(b * y) * sum(a * a) - sum(a * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) ** 2), 6) + 0.0 AS w1
    FROM (SELECT l_returnflag, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem) GROUP BY l_returnflag""")
def lstsq_2var(spark, d):
    """Weights without intercept, for each flag."""
    s = table(spark, d, "lineitem").selectExpr("l_returnflag", "array(l_quantity, l_discount) AS x", "array(l_extendedprice) AS y")
    w = models.solved_by(s, "l_returnflag", "x", "y", 2)
    return w.select("l_returnflag", r6(F.col("weights")[0][0]).alias("w0"), r6(F.col("weights")[1][0]).alias("w1"))


@query("""
    WITH e AS (SELECT user_id AS stim, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS frame, round(epoch_us(ts) / 1e6, 3) AS t_start, event_id, value FROM events)
    SELECT a.stim, a.frame, a.t_start, a.value AS x, b.event_id AS y FROM e AS a JOIN e AS b ON a.stim = b.stim AND a.frame = b.frame AND a.t_start = b.t_start""")
def times_join(spark, d):
    """Features and targets of the same frames, with their times held to be equal."""
    e = align.align_sort(events(spark, d), "user_id", "ts", "event_id", "frame").select(F.col("user_id").alias("stim"), F.col("frame").cast("int").alias("frame"), F.round("t", 3).alias("t_start"), "event_id", "value")
    x, y = e.select("stim", "frame", "t_start", F.col("value").alias("x")), e.select("stim", "frame", "t_start", F.col("event_id").alias("y"))
    return align.times_join(x, y, times=("t_start",)).select("stim", "frame", "t_start", "x", "y")


@query("""
    WITH w AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS w FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * w, 4) + 0.0 AS pred, round(l_quantity * w - l_extendedprice, 4) + 0.0 AS residual FROM lineitem, w""")
def residuals(spark, d):
    s = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "array(l_quantity) AS x", "array(l_extendedprice) AS y")
    fit = models.residuals(models.predict(s, "x", models.lstsq(s, "x", "y", 1)), "pred", "y")
    return fit.select("l_orderkey", "l_linenumber", "l_partkey", (F.round(F.col("pred")[0], 4) + 0.0).alias("pred"), (F.round(F.col("residual")[0], 4) + 0.0).alias("residual"))


@query("""
    SELECT event_type, round(covar_pop(k, value) * count(*) / (var_pop(k) * count(*) + 10), 6) + 0.0 AS w FROM (SELECT event_type, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events) GROUP BY event_type""")
def ridge_1var(spark, d):
    """Slope on a centred feature with a penalty of 10."""
    e = table(spark, d, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    w = models.solved_by(e.select("event_type", F.array("k").alias("x"), F.array("value").alias("y")), "event_type", "x", "y", 1, alpha=10.0, scale=False)
    return w.select("event_type", r6(F.col("weights")[0][0]).alias("w"))


@query()
def ridge_cv(spark, d):
    """Alpha and held-out R2, over three times five folds, of the first two dimensions of a vector on the others."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 3, 62).alias("x"), F.slice("embedding", 1, 2).alias("y"))
    fit = models.ridge_cv(e.join(models.repeated_folds(e, "vec_id", 5, 3), "vec_id"), "x", "y", 62, ["fold0", "fold1", "fold2"])
    rows = [(k, float(a), float(s), bool(a == fit["alpha"])) for k, (a, s) in enumerate(zip(np.logspace(-5, 2, 10), fit["scores"]))]
    return rounded(spark.createDataFrame(rows, "k int, alpha double, r2 double, best boolean"), "alpha", "r2")


@query()
def fold_assign(spark, d):
    return models.fold_of(table(spark, d, "events"), "user_id", 5)


@query()
def split_stimuli(spark, d):
    return models.split_keys(table(spark, d, "events"), "user_id", 3, 0.8, 0.1)


@query()
def pca_scores(spark, d):
    e = table(spark, d, "embeddings")
    model = models.pca(e, "embedding", 64, 13)
    return rounded(vectors.exploded(models.pca_transform(e, "embedding", model), ["vec_id"], "scores"), "x")


@query()
def svd_reduce(spark, d):
    e = table(spark, d, "embeddings")
    _, v = models.svd_reduce(e, "embedding", 64, 5)
    return rounded(vectors.exploded(models.predict(e, "embedding", v, "v"), ["vec_id"], "v"), "x")


@query()
def logistic(spark, d):
    """Class of each vector by a multiclass model of its first eight dimensions."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 8).alias("x"))
    return models.logistic(e, "x", F.col("label"), 100)(e).select("vec_id", "label", "pred")


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Each user's values in order of their ids: held for 160 samples each at 16 kHz, they are read as a waveform."""
    from stimframe.operators.rank import ranked

    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return ranked(e, ["user_id"], [F.col("event_id")], "i").select(F.col("user_id").cast("string").alias("stim"), "i", "value")


@query()
def fbank(spark, d):
    from stimframe.operators.extract import extract_series

    return rounded(vectors.exploded(extract_series(_series(spark, d), "fbank", 160), ["stim", "frame"], "features"), "x")


@query()
def mfcc(spark, d):
    from stimframe.operators.extract import extract_series

    return rounded(vectors.exploded(extract_series(_series(spark, d), "mfcc", 160), ["stim", "frame"], "features"), "x")


@query()
def low_level_descriptors(spark, d):
    from stimframe.operators.extract import extract_series

    return rounded(vectors.exploded(extract_series(_series(spark, d), "lld", 160), ["stim", "frame"], "features"), "x")


@query("""
    WITH g AS (SELECT user_id, epoch_us(ts) AS us, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g)
    SELECT user_id, min(us) // 1000000 AS start, (max(us) + 43200000000) // 1000000 AS stop, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM s GROUP BY user_id, k""")
def session_stream(spark, d):
    """Sessions of each user without a gap of 12 hours; the streaming operator on a batch."""
    from stimframe.streaming.windows import session_stream as sessions

    # The operator takes instants; NTZ times become those at which a clock in UTC shows them.
    e = table(spark, d, "events").withColumn("ts", F.timestamp_micros(align.micros("ts")))
    return rounded(sessions(e, "ts", "12 hours", ["user_id"], "value"), "total")


@query(f"""
    WITH s AS (SELECT *, min(value) OVER u + 0.25 * (max(value) OVER u - min(value) OVER u) AS level FROM {_SERIES} WINDOW u AS (PARTITION BY user_id)),
    r AS (SELECT user_id, i, value > level AS "on", CASE WHEN (value > level) <> lag(value > level) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM s),
    k AS (SELECT user_id, "on", i, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM r)
    SELECT user_id, count(*) AS n_segments, round(avg(n), 6) + 0.0 AS mean_length, max(n) AS max_length FROM (SELECT user_id, run, "on", count(*) AS n FROM k GROUP BY ALL) WHERE "on" GROUP BY user_id""")
def segments_above(spark, d):
    """Runs of values above a quarter of a user's range."""
    runs = functionals.segments_above(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")
    return rounded(functionals.segment_summary(runs, ["user_id"]).select("user_id", "n_segments", "mean_length", "max_length"), "mean_length")


@query(f"""
    WITH t AS (SELECT user_id, i, value, value - lag(value) OVER w AS up, value - lead(value) OVER w AS down, max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id) AS r FROM {_SERIES} WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    e AS (SELECT *, up > 0 AS top, value - lag(value) OVER w AS dv, i - lag(i) OVER w AS dt FROM t WHERE (up > 0 AND down >= 0) OR (up < 0 AND down <= 0) WINDOW w AS (PARTITION BY user_id ORDER BY i))
    SELECT user_id, count_if(top) AS n_maxima, count_if(NOT top) AS n_minima, round(avg(value) FILTER (top), 6) + 0.0 AS mean_maximum, round(max(value) FILTER (top) - min(value) FILTER (top), 6) + 0.0 AS range_maxima,
        round(avg(value) FILTER (NOT top), 6) + 0.0 AS mean_minimum, round(avg(dt), 6) + 0.0 AS mean_distance, round(avg(dv / dt) FILTER (dv > 0), 6) + 0.0 AS mean_rise, round(avg(dv / dt) FILTER (dv < 0), 6) + 0.0 AS mean_fall
    FROM e WHERE abs(dv) > 0.1 * r GROUP BY user_id""")
def turning_points(spark, d):
    found = functionals.turning_points(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")
    return rounded(found, "mean_maximum", "range_maxima", "mean_minimum", "mean_distance", "mean_rise", "mean_fall")


@query()
def voice_descriptors(spark, d):
    from stimframe.operators.extract import extract_series

    return rounded(vectors.exploded(extract_series(_series(spark, d), "voice", 160), ["stim", "frame"], "features"), "x")


@query()
def temporal_rates(spark, d):
    """Of the voice descriptors of each user's series."""
    from stimframe.operators.extract import VOICE, extract_series

    v = extract_series(_series(spark, d), "voice", 160).select("stim", "frame", *[F.col("features")[VOICE.index(c)].alias(c) for c in ("loudness", "f0")])
    return rounded(functionals.temporal_rates(v, ["stim"], ["frame"], "loudness", "f0", 0.02), "peaks_per_second", "voiced_per_second", "mean_voiced", "sd_voiced", "mean_unvoiced", "sd_unvoiced")


@query()
def pitch_path(spark, d):
    """Pitch of each user's series on the path of least cost through the candidates of its frames."""
    from stimframe.operators import prosody

    return rounded(vectors.exploded(prosody.pitch(_series(spark, d), hold=160), ["stim", "frame"], "features"), "x")


@query()
def egemaps_descriptors(spark, d):
    """The 25 low-level descriptors of the eGeMAPS set."""
    from stimframe.operators import prosody

    return rounded(vectors.exploded(prosody.egemaps(_series(spark, d), 160), ["stim", "frame"], "features"), "x")


@query()
def egemaps_functionals(spark, d):
    """The 88 functionals of the eGeMAPS set of each user's series."""
    from stimframe.operators import prosody

    return rounded(vectors.exploded(prosody.egemaps_functionals(_series(spark, d), 160), ["stim"], "features"), "x")


@query()
def compare_descriptors(spark, d):
    """The 65 low-level descriptors of the ComParE set and their slopes."""
    from stimframe.operators import prosody

    return rounded(vectors.exploded(prosody.compare(_series(spark, d), 160, delta=True), ["stim", "frame"], "features"), "x")


@query()
def compare_functionals(spark, d):
    """The 6,373 functionals of the ComParE set of each user's series."""
    from stimframe.operators import prosody

    return rounded(vectors.exploded(prosody.compare_functionals(_series(spark, d), 160), ["stim"], "features"), "x")
