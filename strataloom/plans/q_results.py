"""Queries on the shaping of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import extract, keywords
from strataloom.operators import results as R
from strataloom.operators import vectors as X
from strataloom.plans.q_text import sentence_rows
from strataloom.plans.registry import registry
from strataloom.session import table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)

_MAP = (("sea ice thickness", "ice"), ("sea ice", "ice"), ("glacier melt", "ice"), ("crop yield", "farming"), ("膜污染", "membrane"), ("membrane fouling", "membrane"))
_VALUES = ", ".join(f"('{t}', '{n}', {i})" for i, (t, n) in enumerate(_MAP))


@query(f"WITH m(term, name, ord) AS (VALUES {_VALUES}) SELECT doc_id, name, arg_min(term, ord) AS term FROM documents, m WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(abstract_text, '')), term) GROUP BY doc_id, name")
def mapping_hits(spark, d):
    """JOIN-24: mapping terms found in title and abstract."""
    return R.first_mapping(table(spark, d, "documents"), list(_MAP), ["title", "abstract_text"])


@query(f"WITH m AS ({keywords._META_SQL}), t AS (SELECT left(lower(keyword), 1) AS cluster, lower(keyword) AS term, x.source, count(*) AS freq, max(CASE WHEN m.pos = 0 THEN 1 ELSE 0 END) AS author FROM m JOIN documents x ON m.doc_id = x.doc_id WHERE keyword IS NOT NULL GROUP BY ALL) SELECT cluster, sum(freq)::BIGINT AS freq, count(DISTINCT source) AS sources, arg_max(term, {{'a': author, 'b': freq, 'c': -length(term), 'd': term}}) AS canonical FROM t GROUP BY cluster")
def term_cluster_stats(spark, d):
    """AGG-29: statistics and canonical name of term clusters (here: by first letter)."""
    docs = table(spark, d, "documents")
    k = keywords.of_metadata(docs).where("keyword IS NOT NULL").join(docs.select("doc_id", "source"), "doc_id")
    t = k.groupBy(F.left(F.lower("keyword"), F.lit(1)).alias("cluster"), F.lower("keyword").alias("term"), "source").agg(F.count("*").alias("freq"), F.max((F.col("pos") == 0).cast("int")).alias("author"))
    return R.term_clusters(t)


@query("SELECT count(*) AS n, round(avg(CASE WHEN g = p THEN 1 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN starts_with(g, p) OR starts_with(p, g) THEN 1 ELSE 0 END), 6) AS branch, round(avg(CASE WHEN g[1] = p[1] THEN 1 ELSE 0 END), 6) AS top FROM (SELECT 'B' || p_size AS g, 'B' || (p_partkey % 60) AS p FROM part)")
def taxonomy_accuracy(spark, d):
    """JOIN-21, AGG-22: accuracy of codes at three levels."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("B"), "p_size").alias("gold"), F.concat(F.lit("B"), F.col("p_partkey") % 60).alias("pred"))
    return R.same_branch_hits(p.select("doc_id", "gold"), p.select("doc_id", "pred"))


_C = lambda key: f"SELECT k, list(m ORDER BY dim) AS c FROM (SELECT {key} AS k, i AS dim, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY ALL) GROUP BY k"


@query(
    f"WITH p AS ({_C('label')}), t AS ({_C('label * 3 + vec_id % 3')}), s AS (SELECT vec_id, embedding::DOUBLE[] AS e, p.k AS parent, round(list_cosine_similarity(embedding::DOUBLE[], p.c), 6) AS ps FROM embeddings, p), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY ps DESC, parent) <= 2) "
    "SELECT vec_id AS doc_id, parent, t.k AS topic, round(list_cosine_similarity(e, t.c), 6) AS score FROM b JOIN t ON t.k // 3 = parent"
)
def pruned_topics(spark, d):
    """JOIN-22: topics of the two best parents."""
    e = table(spark, d, "embeddings").withColumn("topic", F.col("label") * 3 + F.col("vec_id") % 3)
    parents = X.centroids(e, "label").select(F.col("label").cast("long").alias("parent"), F.col("centroid").alias("vector"))
    topics = X.centroids(e, "topic").select("topic", F.floor(F.col("topic") / 3).alias("parent"), F.col("centroid").alias("vector"))
    return R.pruned_topics(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), parents, topics)


@query("SELECT user_id AS doc_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS explicit, round(count(*) FILTER (event_type = 'click') / greatest(count(*), 1)::DOUBLE, 3) AS explicit_ratio, count(*) FILTER (value >= 10) AS kept FROM events GROUP BY user_id")
def explicit_ratios(spark, d):
    """RES-09/10: counts before the floor and rows above it."""
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_type") == "click").alias("explicit"), F.col("value").alias("confidence"))
    return R.least_confidence(e, 10)


@query("WITH r AS (SELECT event_id, event_type AS label, least(value / 20, 1) AS confidence, (event_id % 100) / 100.0::DOUBLE AS similarity FROM events) SELECT event_id, CASE WHEN confidence < 0.95 AND similarity > 0.7 THEN 'user' ELSE label END AS label, round(CASE WHEN confidence < 0.95 AND similarity > 0.7 THEN similarity ELSE confidence END, 6) AS confidence FROM r")
def label_override(spark, d):
    """RES-13: labels overridden by the user's."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("label"), F.least(F.col("value") / 20, F.lit(1.0)).alias("confidence"), ((F.col("event_id") % 100) / 100.0).alias("similarity"), F.lit("user").alias("user_label"))
    return R.user_override(e).select("event_id", "label", F.round("confidence", 6).alias("confidence"))


@query("WITH r AS (SELECT p_brand AS task, p_size AS k, round(p_retailprice / 2000, 6) AS score, p_partkey FROM part) SELECT task, arg_max(k, {'a': s, 'b': -k}) AS k, max(s) AS score FROM (SELECT task, k, round(0.45::DOUBLE * score + 0.30::DOUBLE * 0.5::DOUBLE + 0.15::DOUBLE * score - 0.10::DOUBLE * 0.1::DOUBLE, 6) AS s FROM r) GROUP BY task")
def automatic_k(spark, d):
    """CLU-06: number of clusters chosen from candidates."""
    p = F.round(F.col("p_retailprice") / 2000, 6)
    return R.best_k(table(spark, d, "part").select(F.col("p_brand").alias("task"), F.col("p_size").alias("k"), p.alias("silhouette"), F.lit(0.5).alias("stability"), p.alias("balance"), F.lit(0.1).alias("undersized")))


@query("WITH r AS (SELECT o_custkey AS doc_id, o_orderkey::VARCHAR AS keyword, CASE WHEN o_orderstatus = 'F' THEN least(1.0::DOUBLE, greatest(0.75::DOUBLE, floor(o_totalprice / 1000) / 500 + least(0.2::DOUBLE, 0.5::DOUBLE))) ELSE least(floor(o_totalprice / 1000) / 500, 0.95::DOUBLE) END AS w FROM orders) SELECT doc_id, keyword, round(w, 6) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 6) DESC, keyword) AS rank FROM r WHERE round(w, 6) >= 0.5 QUALIFY rank <= 8")
def keyword_fusion(spark, d):
    """EXT-10: fused keyword weights with threshold and limit."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("keyword"), (F.floor(F.col("o_totalprice") / 1000) / 500).alias("fitness"), (F.col("o_orderstatus") == "F").alias("in_dictionary"), F.lit(0.2).alias("boost"))
    return R.fused_keywords(o)


@query("SELECT lang AS language, source AS parent, count(*) AS support, min(doc_id) AS example FROM documents GROUP BY ALL HAVING count(*) >= 3")
def topic_proposals(spark, d):
    """CLU-16: proposals by language and parent with enough support."""
    return R.proposed_topics(table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("parent")))


@query()
def question_merge(spark, d):
    """RES-06/07: questions of an abstract merged."""
    s = sentence_rows(table(spark, d, "documents"), "abstract_text")
    q = extract.questions(s).join(s.select("doc_id", "idx", "sentence"), ["doc_id", "idx"])
    return R.merged_questions(q.select("doc_id", "idx", F.col("sentence").alias("question"), (F.col("score") / 10.0).alias("confidence")))


@query(f"WITH e AS (SELECT DISTINCT doc_id, keyword AS entity FROM ({keywords._META_SQL}) WHERE keyword IS NOT NULL) SELECT doc_id, entity FROM e a WHERE NOT (length(entity) >= 6 AND (SELECT count(*) FROM e b WHERE b.doc_id = a.doc_id AND b.entity <> a.entity AND length(b.entity) >= 3 AND contains(a.entity, b.entity)) >= 2)")
def atomic_entities(spark, d):
    """RES-02: composite entities dropped."""
    k = keywords.of_metadata(table(spark, d, "documents")).where("keyword IS NOT NULL").select("doc_id", F.col("keyword").alias("entity"))
    return R.composite_free(k)
