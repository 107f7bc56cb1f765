"""Queries on result documents of the tools, made here from the stored papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import extract, keywords
from strataloom.plans.registry import registry
from strataloom.sources import projections as P
from strataloom.session import table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)

_KW = keywords._META_SQL


def _keyword_results(spark, d):
    k = keywords.of_metadata(table(spark, d, "documents")).where("keyword IS NOT NULL")
    item = F.struct(F.col("keyword"), (F.col("pos") + 1).alias("rank"), F.lit("").alias("term"), F.round(0.95 - 0.1 * F.col("pos"), 4).alias("weight"))
    lists = k.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("a"))
    return lists.select(F.col("doc_id").alias("record_id"), F.when(F.col("doc_id") % 2 == 0, "zh-keyword").otherwise("en-keyword").alias("tool_id"), F.to_json(F.struct(F.transform("a", lambda x: x["item"]).alias("keywords"))).alias("result"))


@query(f"SELECT doc_id AS record_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS place, keyword AS term, NULL AS normalized_term, round(0.95 - 0.1 * pos, 4)::DOUBLE AS score, (pos + 1)::DOUBLE AS rank_no, NULL AS source_name, NULL AS mapping_json FROM ({_KW}) WHERE keyword IS NOT NULL")
def keyword_items(spark, d):
    """SNK-06, PRJ-13: keyword results as rows; the first of the fields that is there counts."""
    return P.section(_keyword_results(spark, d), "keyword_items")


@query(f"{extract._SPANS} SELECT doc_id AS record_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, entity) - 1)::INT AS place, NULL AS entity_id, entity AS text_value, upper(entity) AS normalized_text, type AS entity_type, start_pos::DOUBLE AS start_offset, end_pos::DOUBLE AS end_offset, NULL AS context_text, NULL::DOUBLE AS confidence FROM spans WHERE doc_id % 5 <> 4")
def entity_mentions(spark, d):
    """SNK-06, PRJ-13: entity results as rows; results that are cut off give none."""
    spans = extract.scan_lexicon(table(spark, d, "documents"), "abstract_text", extract.LEXICON)
    item = F.struct("entity", F.col("type"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.upper("entity").alias("standard_term"))
    r = spans.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "entity", item.alias("item")))), lambda x: x["item"]).alias("entities"))
    raw = F.to_json(F.struct("entities"))
    raw = F.when(F.col("doc_id") % 5 == 4, F.substring(raw, 1, 20)).otherwise(raw)
    return P.section(r.select(F.col("doc_id").alias("record_id"), F.lit("general-ner").alias("tool_id"), raw.alias("result")), "entity_mentions")


@query("SELECT label AS record_id, 'C' || (vec_id % 3) AS cluster_id, (row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) - 1)::INT AS place, 'V' || vec_id AS document_id, NULL AS title, round(embedding[1]::DOUBLE, 4) AS similarity FROM embeddings")
def cluster_memberships(spark, d):
    """SNK-06: members of nested cluster results."""
    e = table(spark, d, "embeddings")
    member = F.struct("vec_id", F.struct(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("document_id"), F.round(F.col("embedding")[0].cast("double"), 4).alias("similarity")).alias("m"))
    c = e.groupBy("label", (F.col("vec_id") % 3).alias("c")).agg(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["m"]).alias("members"))
    r = c.groupBy("label").agg(F.collect_list(F.struct(F.concat(F.lit("C"), F.col("c").cast("string")).alias("cluster_id"), "members")).alias("clusters"))
    return P.memberships(r.select(F.col("label").alias("record_id"), F.lit("deep-cluster").alias("tool_id"), F.to_json(F.struct("clusters")).alias("result")))


@query(
    "WITH t AS (SELECT r_regionkey AS record_id, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey) SELECT record_id, 'Q' || record_id AS node_id, NULL AS parent_node_id, 1 AS level_no, 'research_question' AS node_type, r_name AS title, NULL AS content FROM (SELECT r_regionkey AS record_id, r_name FROM region) "
    "UNION ALL SELECT record_id, 'node_2_' || row_number() OVER (PARTITION BY record_id ORDER BY n_nationkey), 'Q' || record_id, 2, 'method', n_name, 'text ' || n_nationkey FROM t"
)
def review_nodes(spark, d):
    """SNK-06: nodes of nested reviews with level and parent."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("method"), F.concat(F.lit("text "), x["n_nationkey"].cast("string")).alias("summary"))).alias("methods"))
    r = table(spark, d, "region").join(n, "r_regionkey")
    tree = F.array(F.struct(F.concat(F.lit("Q"), F.col("r_regionkey").cast("string")).alias("rq_id"), F.col("r_name").alias("research_question"), "methods"))
    return P.review_nodes(r.select(F.col("r_regionkey").alias("record_id"), F.lit("structured-review").alias("tool_id"), F.to_json(F.struct(tree.alias("tree"))).alias("result")))
