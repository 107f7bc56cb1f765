"""Queries for trends, distributions and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import evaluation as E
from strataloom.operators import reports as P
from strataloom.plans.registry import registry
from strataloom.session import table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)

_PY = r"TRY_CAST(nullif(regexp_extract(metadata_json, '\x{22}published_at\x{22}: \x{22}(\d{4})', 1), '') AS INTEGER)"
_ROWS = f"SELECT source AS cluster, {_PY} AS year, least(n_chars / 2000.0::DOUBLE, 1) AS relevance FROM documents WHERE {_PY} IS NOT NULL"


def _papers(spark, d):
    y = F.regexp_extract("metadata_json", r'"published_at": "(\d{4})', 1).try_cast("int")
    return table(spark, d, "documents").select(F.col("source").alias("cluster"), y.alias("year"), F.least(F.col("n_chars") / 2000.0, F.lit(1.0)).alias("relevance")).where("year IS NOT NULL")


@query(f"WITH r AS ({_ROWS}), e AS (SELECT min(year) AS lo, max(year) AS hi FROM r), g AS (SELECT cluster, y.year FROM (SELECT DISTINCT cluster FROM r), e, unnest(range(lo, hi + 1)) AS y(year)) SELECT g.cluster, g.year::INTEGER AS year, count(r.year) AS n FROM g LEFT JOIN r ON g.cluster = r.cluster AND g.year = r.year GROUP BY ALL")
def yearly_trend(spark, d):
    """AGG-05: papers by cluster and year on the full grid."""
    return P.yearly_grid(_papers(spark, d))


_TREND = f"""WITH r AS ({_ROWS}), m AS (SELECT max(year) AS y FROM r), c AS (SELECT cluster, year, count(*) AS n FROM r GROUP BY ALL), g AS (SELECT cluster, y, min(year) AS first, sum(n)::BIGINT AS total, count(*) AS years,
coalesce(sum(n) FILTER (year >= y - 2), 0)::BIGINT AS recent, coalesce(sum(n) FILTER (year BETWEEN y - 5 AND y - 3), 0)::BIGINT AS previous FROM c, m GROUP BY cluster, y),
t AS (SELECT cluster, first, total, recent, previous, CASE WHEN first >= y - 2 THEN 'emerging' WHEN recent >= greatest(2, 2 * previous) THEN 'rising' WHEN y - first + 1 >= 5 AND years / (y - first + 1)::DOUBLE >= 0.5 AND previous >= 1 AND recent / nullif(previous, 0)::DOUBLE BETWEEN 0.5 AND 2 THEN 'stable' END AS trend FROM g)"""


@query(_TREND + " SELECT * FROM t")
def trend_class(spark, d):
    """AGG-06: trend of every cluster."""
    return P.trend_classes(_papers(spark, d))


@query(_TREND + " SELECT trend, arg_max(cluster, {'a': total, 'b': cluster}) AS cluster FROM t WHERE trend IS NOT NULL GROUP BY trend")
def trend_representatives(spark, d):
    """AGG-07: the largest cluster of every trend."""
    return P.representatives(P.trend_classes(_papers(spark, d)))


@query(f"WITH r AS ({_ROWS}), e AS (SELECT min(year) AS lo, max(year) AS hi FROM r), g AS (SELECT cluster, count(*) FILTER (NOT year > (lo + hi) / 2.0) AS early, count(*) FILTER (year > (lo + hi) / 2.0) AS late FROM r, e GROUP BY cluster) SELECT *, CASE WHEN late > early * 1.2::DOUBLE THEN 'up' WHEN late < early * 0.8::DOUBLE THEN 'down' ELSE 'flat' END AS trend FROM g")
def trend_fallback(spark, d):
    """AGG-08: the second, simpler definition of a trend."""
    return P.half_trends(_papers(spark, d))


@query(
    f"""WITH r AS ({_ROWS}), e AS (SELECT max(year) AS y, count(*) AS al, count(DISTINCT year) AS span FROM r), g AS (SELECT cluster, count(*) AS n, round(least(greatest(0.4::DOUBLE * avg(CASE WHEN year >= y - 2 THEN 1 ELSE 0 END) + 0.25::DOUBLE * avg(relevance) + 0.2::DOUBLE * count(DISTINCT year) / any_value(span) + 0.15::DOUBLE * count(*) / any_value(al), 0.05), 1), 3) AS score FROM r, e GROUP BY cluster)
    SELECT *, CASE WHEN score >= 0.6 THEN 'hot' WHEN score >= 0.4 THEN 'warm' ELSE 'cool' END AS status FROM g"""
)
def hotspot_score(spark, d):
    """AGG-09: hotspot score and status of every cluster."""
    return P.hotspots(_papers(spark, d))


@query("SELECT p_type, p_size, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY ALL")
def distribution_report(spark, d):
    """AGG-17: distribution of parts over types and sizes."""
    return P.distribution(table(spark, d, "part"), ["p_type", "p_size"], "p_retailprice")


@query("SELECT coalesce(o_orderpriority, 'all') AS split, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def evaluation_by_split(spark, d):
    """AGG-20: means overall and by split."""
    return P.by_split(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


@query("SELECT source, printf('C%02d', row_number() OVER (ORDER BY min(doc_id), source)) AS ordinal FROM documents GROUP BY source")
def ordinal_clusters(spark, d):
    """WIN-09: ordinal ids by first appearance."""
    return P.ordinal_ids(table(spark, d, "documents"), "source", "doc_id")


@query(
    """WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey AS id, o_totalprice AS fit FROM orders WHERE o_totalprice >= 200000), w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY fit DESC, id) AS rank, max(fit) OVER (PARTITION BY o_custkey, o_orderpriority) AS top FROM r)
    SELECT o_custkey, o_orderpriority, id, fit, rank FROM w WHERE rank = 1 OR (rank = 2 AND top - fit <= 75000)"""
)
def top_one_or_two(spark, d):
    """WIN-06: best of every type, and the second where it is near."""
    r = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("fit"))
    return P.topk_per_type(r, ["o_custkey", "o_orderpriority"], "fit", 200000, 75000)


@query("SELECT doc_id, coalesce(CASE WHEN n_chars > 1500 THEN NULL ELSE n_chars / 2000.0::DOUBLE END, (SELECT round(avg(CASE WHEN n_chars > 1500 THEN NULL ELSE n_chars / 2000.0::DOUBLE END), 3) FROM documents), 0.9) AS confidence FROM documents")
def confidence_imputed(spark, d):
    """RES-04: missing confidences take the mean."""
    r = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, None).otherwise(F.col("n_chars") / 2000.0).alias("confidence"))
    return P.imputed(r, "confidence")


@query("SELECT source AS task, arg_min(answer, {'a': -n, 'b': answer}) AS answer, round(max(n) / sum(n)::DOUBLE, 6) AS share, round(arg_min(c, {'a': -n, 'b': answer}) * max(n) / sum(n)::DOUBLE, 6) AS score FROM (SELECT source, coalesce(lang, 'und') AS answer, count(*) AS n, avg(least(n_chars / 2000.0::DOUBLE, 1)) AS c FROM documents GROUP BY ALL) GROUP BY source")
def consistency_vote(spark, d):
    """AGG-26/27: share of the most common answer times its mean confidence."""
    r = table(spark, d, "documents").select(F.col("source").alias("task"), F.coalesce("lang", F.lit("und")).alias("answer"), F.least(F.col("n_chars") / 2000.0, F.lit(1.0)).alias("confidence"))
    return E.vote(r, "task")


_K = "SELECT doc_id, title, from_json(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '{\"keywords\": [\"VARCHAR\"]}').keywords AS k FROM documents"


@query(
    f"""WITH m AS ({_K}), t AS (SELECT doc_id, list_distinct(list_transform(k, lambda x: lower(x))) AS gold, list_distinct(list_filter(list_transform(k, lambda x: lower(x)), lambda x: contains(lower(coalesce(title, '')), x))) AS pred FROM m WHERE k IS NOT NULL AND len(k) > 0)
    SELECT count(*) AS docs, round(avg(len(list_intersect(gold, pred)) / len(gold)::DOUBLE), 6) AS recall, round(avg(CASE WHEN len(pred) = 0 THEN 0 ELSE len(list_intersect(gold, pred)) / len(pred)::DOUBLE END), 6) AS precision, round(avg(len(list_intersect(gold, pred)) / len(list_distinct(list_concat(gold, pred)))::DOUBLE), 6) AS jaccard FROM t"""
)
def keyword_prf(spark, d):
    """AGG-19, SET-08: keyword precision and recall averaged over documents."""
    k = F.from_json("metadata_json", "struct<keywords:array<string>>").getField("keywords")
    m = table(spark, d, "documents").select("doc_id", F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.array_distinct(F.transform(k, F.lower)).alias("gold")).where(F.size("gold") > 0)
    m = m.withColumn("pred", F.filter("gold", lambda x: F.contains(F.col("t"), x)))
    hit = F.size(F.array_intersect("gold", "pred"))
    return m.agg(F.count("*").alias("docs"), F.round(F.avg(hit / F.size("gold")), 6).alias("recall"), F.round(F.avg(F.when(F.size("pred") == 0, 0.0).otherwise(hit / F.size("pred"))), 6).alias("precision"), F.round(F.avg(P.jaccard("gold", "pred")), 6).alias("jaccard"))


@query("SELECT l_orderkey AS sentence, l_returnflag AS label, list_sort(list_distinct(list(l_linenumber))) AS marks, max(l_discount) AS confidence, min(l_partkey) AS first FROM lineitem GROUP BY ALL")
def citation_merge(spark, d):
    """RES-11: rows of one sentence and label merged."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sentence"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("mark"), F.col("l_discount").alias("confidence"), F.col("l_partkey").alias("ord"))
    return P.merged_marks(r)


@query("SELECT fold, sum(matched)::BIGINT AS matched, count(DISTINCT rule) AS rules, row_number() OVER (ORDER BY count(DISTINCT rule) DESC, fold) AS place FROM (SELECT o_orderpriority AS fold, o_custkey % 7 AS rule, 1 AS matched FROM orders) GROUP BY fold")
def fold_aggregation(spark, d):
    """AGG-24: rules summed over folds and ordered."""
    r = table(spark, d, "orders").select(F.col("o_orderpriority").alias("fold"), (F.col("o_custkey") % 7).alias("rule"))
    g = r.groupBy("fold").agg(F.count("*").alias("matched"), F.countDistinct("rule").alias("rules"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rules"), "fold")))  # one row a fold


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    """Conditional sums and means over the largest table, with the filter pushed to the scan."""
    r = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '2000-09-02'")
    return r.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def nation_revenue(spark, d):
    """Six-way join; sides are broadcast only where their measured size allows it."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    j = j.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
