"""Queries on document-level shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import documents as D
from strataloom.operators import extract, keywords
from strataloom.plans.q_text import HAN, _count, sentence_rows, sents
from strataloom.plans.registry import registry
from strataloom.session import table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)

_BODY = "coalesce(nullif(trim(abstract_text, ' '), ''), nullif(trim(content_text, ' '), ''))"
_KEYS = "from_json(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '{\"keywords\": [\"VARCHAR\"]}').keywords"


@query(
    rf"""WITH b AS (SELECT *, {_BODY} AS body FROM documents) SELECT printf('D%02d', doc_id) AS document_id, coalesce(nullif(trim(title, ' '), ''), substring(body, 1, 40)) AS title, body,
    coalesce(TRY_CAST(nullif(regexp_extract(metadata_json, '((?:19|20)\d{{2}})', 1), '') AS INTEGER), year(created_at))::INTEGER AS year, CASE WHEN {_count('body', HAN)} / greatest(length(body), 1) > 0.08 THEN 'zh' ELSE 'en' END AS language FROM b WHERE body IS NOT NULL"""
)
def normalised_papers(spark, d):
    """PRJ-01: documents in normal form."""
    return D.normalised(table(spark, d, "documents"))


@query(
    f"""WITH n AS (SELECT doc_id, length(coalesce(title, '')) AS t, length(coalesce(abstract_text, '')) AS a, coalesce(len({_KEYS}), 0) AS k FROM documents)
    SELECT doc_id, CASE WHEN t >= 5 AND a >= 80 AND k >= 2 THEN 'structured' ELSE 'plain' END AS mode, list_filter([CASE WHEN t > 0 THEN 'title' END, CASE WHEN a > 0 THEN 'abstract' END, CASE WHEN k > 0 THEN 'keywords' END], lambda x: x IS NOT NULL) AS fields_used, t + a AS size FROM n"""
)
def input_representation(spark, d):
    """PRJ-02, PRJ-08: structured or plain input of every document."""
    return D.representation(table(spark, d, "documents"))


def _cues(words) -> str:
    return " + ".join(f"CASE WHEN contains(lower(sentence), '{w}') THEN 1 ELSE 0 END" for w in words)


@query(f"WITH s AS ({sents('abstract_text')}), t AS (SELECT doc_id, idx, 1 + 2 * ({_cues(D.AXES['technology'])}) AS score FROM s), r AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) <= 4) SELECT doc_id, idx, score, round(score / sum(score) OVER (PARTITION BY doc_id)::DOUBLE, 6) AS weight FROM r")
def axis_view(spark, d):
    """PRJ-05/06: best sentences of the technology axis."""
    return D.axis_sentences(sentence_rows(table(spark, d, "documents"), "abstract_text"), "technology")


def _facet_sql() -> str:
    low = "lower(coalesce(abstract_text, ''))"
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains({low}, {w!r})' for w in words)} THEN '{name}' END" for name, words in D.FACETS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH f AS (SELECT doc_id, {_facet_sql()} AS facets FROM documents) SELECT doc_id, facets, CASE WHEN len(facets) >= 2 THEN array_to_string(facets, '+') END AS filled FROM f")
def facet_fill(spark, d):
    """RUL-13: facets of the abstracts."""
    return D.facets(table(spark, d, "documents"), "abstract_text")


def _evidence_sql() -> str:
    parts = []
    for alias, name, context, weight in D.EVIDENCE:
        for field, fw in (("title", 1.0), ("abstract_text", 0.8)):
            low = f"lower(coalesce({field}, ''))"
            need = f" AND contains({low}, '{context}')" if context else ""
            parts.append(f"SELECT doc_id, '{name}' AS name, '{field}' AS field, {round(weight * fw, 4)}::DOUBLE AS confidence FROM documents WHERE instr({low}, '{alias}') > 0{need} AND NOT regexp_matches(substring({low}, greatest(instr({low}, '{alias}') - 30, 1), least(instr({low}, '{alias}') - 1, 29)), '{D.NEGATION}')")
    return " UNION ALL ".join(parts)


@query(f"WITH h AS ({_evidence_sql()}) SELECT doc_id, name, max(confidence) AS confidence, arg_max(field, {{'a': confidence, 'b': field}}) AS field FROM h GROUP BY doc_id, name")
def evidence_rules(spark, d):
    """RUL-10: evidence by alias, context, negation and field weight."""
    return D.evidence(table(spark, d, "documents"), {"title": 1.0, "abstract_text": 0.8})


@query("SELECT count(*) AS docs, round(avg(CASE WHEN n > 0 THEN 1 ELSE 0 END), 6) AS covered, sum(n)::BIGINT AS hits FROM (SELECT x.doc_id, count(h.name) AS n FROM documents x LEFT JOIN (SELECT DISTINCT doc_id, name FROM (" + _evidence_sql() + ")) h ON x.doc_id = h.doc_id GROUP BY x.doc_id)")
def evidence_coverage(spark, d):
    """AGG-31: share of documents with evidence and all hits."""
    docs = table(spark, d, "documents")
    h = D.evidence(docs, {"title": 1.0, "abstract_text": 0.8}).groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(h, "doc_id", "left").agg(F.count("*").alias("docs"), F.round(F.avg(F.when(F.col("n") > 0, 1).otherwise(0)), 6).alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))


_TERMS = (("Sea Ice", "topic", 1), ("sea ice thickness", "topic", 2), ("Crop", "topic", 3), ("Urban-noise", "topic", 4), ("soil erosion control", "topic", 5), ("Soil", "metric", 6), ("wind", "metric", 7), ("海冰", "topic", 8))
_VOC = f"SELECT * FROM (VALUES {', '.join(map(str, _TERMS))}) v(term, type, ord)"
_SURF = "trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ')"


@query(
    f"""WITH e AS (SELECT DISTINCT keyword AS entity, CASE pos % 3 WHEN 2 THEN 'metric' ELSE 'topic' END AS type FROM ({keywords._META_SQL}) m WHERE keyword IS NOT NULL), v AS (SELECT {_SURF.format(c='term')} AS form, term, type, ord FROM ({_VOC})), f AS (SELECT entity, type, {_SURF.format(c='entity')} AS form FROM e),
    x AS (SELECT entity, f.type, arg_min(term, ord) AS term, 'exact' AS how FROM f JOIN v ON f.form = v.form AND f.type = v.type GROUP BY ALL), p AS (SELECT f.entity, f.type, arg_min(v.term, v.ord) AS term, 'part' AS how FROM f JOIN v ON f.type = v.type AND (contains(f.form, v.form) OR contains(v.form, f.form)) WHERE length(f.form) >= 2 AND NOT EXISTS (SELECT 1 FROM x WHERE x.entity = f.entity AND x.type = f.type) GROUP BY f.entity, f.type)
    SELECT * FROM x UNION ALL SELECT * FROM p"""
)
def vocabulary_match(spark, d):
    """JOIN-11/12, STR-02: keywords matched with a standard vocabulary of their type."""
    voc = spark.createDataFrame(_TERMS, "term string, type string, ord int")
    kind = F.when(F.col("pos") % 3 == 2, "metric").otherwise("topic")
    e = keywords.of_metadata(table(spark, d, "documents")).where("keyword IS NOT NULL").select(F.col("keyword").alias("entity"), kind.alias("type"))
    return D.matched_entities(e, voc)


@query(extract._SPANS + f""", g AS (SELECT DISTINCT doc_id, keyword AS gold FROM ({keywords._META_SQL}) m), pr AS (SELECT DISTINCT doc_id, entity AS pred FROM spans), j AS (SELECT g.doc_id, gold, pred, string_split(lower(gold), ' ') AS a, string_split(lower(pred), ' ') AS b FROM g JOIN pr ON g.doc_id = pr.doc_id),
hh AS (SELECT *, CASE WHEN lower(gold) = lower(pred) THEN 'equal' WHEN contains(lower(gold), lower(pred)) OR contains(lower(pred), lower(gold)) THEN 'contained' WHEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE >= 0.6 THEN 'overlap' END AS how FROM j) SELECT doc_id, gold, count(*) AS matches, min(how) AS best FROM hh WHERE how IS NOT NULL GROUP BY doc_id, gold""")
def fuzzy_gold_match(spark, d):
    """JOIN-19/20: extracted entities matched with the stored keywords."""
    docs = table(spark, d, "documents")
    gold = keywords.of_metadata(docs).select("doc_id", F.col("keyword").alias("gold")).distinct()
    pred = extract.scan_lexicon(docs, "abstract_text", extract.LEXICON).select("doc_id", F.col("entity").alias("pred")).distinct()
    return D.gold_matches(gold, pred)


@query("WITH r AS (SELECT p_partkey AS doc_id, CASE p_size % 4 WHEN 0 THEN 'TP391.1' WHEN 1 THEN 'TM7' WHEN 2 THEN 'R5' ELSE 'TP2' END AS main, CASE p_size % 3 WHEN 0 THEN 'R73' WHEN 1 THEN 'TP3' END AS aux, p_retailprice / 1500 AS confidence FROM part), c AS (SELECT *, CASE WHEN main[1] = 'T' THEN left(main, 2) ELSE left(main, 1) END <> CASE WHEN aux[1] = 'T' THEN left(aux, 2) ELSE left(aux, 1) END AS crosses FROM r) SELECT doc_id, CASE WHEN regexp_matches(main, '^(TP18|TP391|TP751)') AND crosses THEN aux ELSE main END AS main, CASE WHEN regexp_matches(main, '^(TP18|TP391|TP751)') AND crosses THEN main WHEN crosses THEN aux END AS aux, round(least(confidence, 0.95), 6) AS confidence, coalesce(crosses, false) AS interdisciplinary FROM c")
def classification_checks(spark, d):
    """RET-04, RES-21/33/34, SET-16, PRJ-14: codes swapped, dropped and capped."""
    p = F.col("p_size")
    r = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.when(p % 4 == 0, "TP391.1").when(p % 4 == 1, "TM7").when(p % 4 == 2, "R5").otherwise("TP2").alias("main"), F.when(p % 3 == 0, "R73").when(p % 3 == 1, "TP3").alias("aux"), (F.col("p_retailprice") / 1500).alias("confidence"))
    return D.postvalidated(r)


@query("SELECT vec_id, round(0.50 * centroid + 0.23 * proto + 0.17 * lexical + 0.10 * parent, 6) AS score, CASE WHEN round(0.50 * centroid + 0.23 * proto + 0.17 * lexical + 0.10 * parent, 6) >= 0.55 THEN 'matched' WHEN round(0.50 * centroid + 0.23 * proto + 0.17 * lexical + 0.10 * parent, 6) >= 0.4 THEN 'review' ELSE 'new' END AS decision FROM (SELECT vec_id, abs(embedding[1]::DOUBLE) AS centroid, abs(embedding[2]::DOUBLE) AS proto, abs(embedding[3]::DOUBLE) AS lexical, abs(embedding[4]::DOUBLE) AS parent FROM embeddings)")
def topic_decisions(spark, d):
    """CLU-14, CLU-17: decision for every item from four similarities."""
    e = F.col("embedding")
    r = table(spark, d, "embeddings").select("vec_id", *(F.abs(e[i].cast("double")).alias(n) for i, n in enumerate(("centroid", "proto", "lexical", "parent"))))
    return D.topic_map(r).select("vec_id", "score", "decision")


@query("SELECT a.vec_id AS item_a, b.vec_id AS item_b, round(avg(CASE WHEN a.l = b.l THEN 1 ELSE 0 END), 6) AS share FROM (SELECT vec_id, vec_id // 20 AS block, r, (vec_id * r) % 5 AS l FROM embeddings, range(1, 5) t(r)) a JOIN (SELECT vec_id, vec_id // 20 AS block, r, (vec_id * r) % 5 AS l FROM embeddings, range(1, 5) t(r)) b ON a.block = b.block AND a.r = b.r AND a.vec_id < b.vec_id GROUP BY ALL")
def consensus_pairs(spark, d):
    """CLU-07: co-assignment over four runs within blocks of twenty."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("block"), F.col("vec_id").alias("item"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("run"))
    return D.coassignment(e.withColumn("label", (F.col("item") * F.col("run")) % 5))


@query("SELECT task_id, list_transform(list_sort(list({'k': input_index, 'v': status})), lambda x: x.k || '=' || x.v) AS latest FROM (SELECT task_id, input_index, arg_max(status, {'a': coalesce(updated_at, TIMESTAMP '1900-01-01'), 'b': id}) AS status FROM task_items GROUP BY ALL) GROUP BY task_id")
def latest_confirmations(spark, d):
    """AGG-04: last value of every key of a record, as a sorted list of entries."""
    t = table(spark, d, "task_items").withColumn("u", F.coalesce("updated_at", F.to_timestamp_ntz(F.lit("1900-01-01 00:00:00"))))
    m = D.latest_map(t, "task_id", "input_index", ["u", "id"], "status")
    return m.select("task_id", F.transform(F.map_entries("latest"), lambda x: F.concat(x["key"], F.lit("="), x["value"])).alias("latest"))


@query(extract.QUESTIONS_SQL.format(sents=sents("abstract_text")).replace("SELECT doc_id, idx, score, row_number()", "SELECT doc_id, idx, CASE WHEN p = 0 THEN 'RQP0' ELSE 'RQS' || p END AS question_id, CASE WHEN p > 0 THEN 'RQP0' END AS parent_id FROM (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS p FROM (SELECT doc_id, idx, score, row_number()") + "))")
def question_hierarchy(spark, d):
    """RES-08: main and sub questions of every document."""
    return D.hierarchy(extract.questions(sentence_rows(table(spark, d, "documents"), "abstract_text")))


@query("SELECT doc_id, regexp_replace(content_text, '([A-Za-z]{2,})-\n([a-z]{2,})', '\\1\\2', 'g') AS rejoined FROM documents WHERE content_text IS NOT NULL")
def hyphen_rejoin(spark, d):
    """STR-20: words parted at line ends joined."""
    return table(spark, d, "documents").where("content_text IS NOT NULL").select("doc_id", D.rejoined(F.col("content_text")).alias("rejoined"))


@query("SELECT tool_id, count(*) AS tasks, round(avg(CASE WHEN success_count = total THEN 1 ELSE 0 END), 6) AS exact, round(avg(success_count / greatest(total, 1)::DOUBLE), 6) AS partial, round(avg(CASE WHEN model_version IS NULL THEN 1 ELSE 0 END), 6) AS unversioned FROM analysis_tasks GROUP BY tool_id")
def accuracy_by_tool(spark, d):
    """AGG-22: several conditional averages in one pass."""
    t = table(spark, d, "analysis_tasks").groupBy("tool_id")
    return t.agg(F.count("*").alias("tasks"), F.round(F.avg((F.col("success_count") == F.col("total")).cast("int")), 6).alias("exact"), F.round(F.avg(F.col("success_count") / F.greatest("total", F.lit(1))), 6).alias("partial"), F.round(F.avg(F.col("model_version").isNull().cast("int")), 6).alias("unversioned"))
