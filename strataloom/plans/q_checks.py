"""Queries on checks and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import checks as C
from strataloom.operators import extract, keywords, rules
from strataloom.operators import relational as L
from strataloom.operators import vectors as X
from strataloom.plans.q_text import labelled_rows, sentence_rows, sents
from strataloom.plans.q_vectors import _CENT
from strataloom.plans.registry import registry
from strataloom.session import table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)

_KW = keywords._META_SQL
_NAME = "CASE doc_id % 4 WHEN 0 THEN 'a.txt' WHEN 1 THEN 'b.pdf' WHEN 2 THEN 'c.xyz' ELSE 'd.docx' END"
_PROBLEM = """CASE WHEN doc_id % 4 = 2 THEN 'unknown suffix' WHEN t = '' THEN 'empty' WHEN doc_id % 4 = 1 THEN CASE WHEN NOT contains(left(t, 1024), '%PDF') THEN 'not a pdf' END WHEN doc_id % 4 = 3 THEN 'not an office file'
WHEN length(t) >= 20 AND len(regexp_extract_all(t, '[\\x{fffd}\\x00-\\x07\\x0b\\x0e-\\x1f]')) / length(t) > 0.05 THEN 'unreadable' WHEN length(regexp_replace(t, '\\s+', '', 'g')) < 10 THEN 'too short' END"""


@query(f"SELECT doc_id, {_PROBLEM} AS problem FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '%PDF-1.4 ' ELSE '' END || coalesce(content_text, '') AS t FROM documents WHERE NOT (doc_id % 4 = 0 AND doc_id % 5 = 0)) UNION ALL SELECT doc_id, 'binary content' FROM documents WHERE doc_id % 20 = 0")
def file_checks(spark, d):
    """SRC-01, SRC-07: uploaded contents that are refused, with the reason (contents under made-up names)."""
    head = F.when(F.col("doc_id") % 5 == 0, "%PDF-1.4 ").otherwise("")
    name = F.element_at(F.array(*(F.lit(x) for x in ("a.txt", "b.pdf", "c.xyz", "d.docx"))), (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.encode(F.concat(head, F.coalesce("content_text", F.lit(""))), "UTF-8")
    return table(spark, d, "documents").select("doc_id", C.content_problem(name, content).alias("problem"))


@query("SELECT x.workspace_id AS batch, x.doc_id AS place, x.file_id AS key, CASE WHEN f.stored_at IS NULL THEN 'missing' WHEN epoch(x.created_at) - epoch(f.stored_at) > 259200 THEN 'expired' ELSE 'hit' END AS state FROM documents x LEFT JOIN (SELECT id, max(created_at) AS stored_at FROM files GROUP BY id) f ON x.file_id = f.id WHERE x.file_id IS NOT NULL")
def cached_parses(spark, d):
    """SRC-16, DATE-04: parses taken from the cache in the order of the requests, or expired, or missing."""
    r = table(spark, d, "documents").where("file_id IS NOT NULL").select(F.col("workspace_id").alias("batch"), F.col("doc_id").alias("place"), F.col("file_id").alias("key"), F.col("created_at").alias("asked_at"))
    return C.taken(r, table(spark, d, "files").select(F.col("id").alias("key"), F.col("created_at").alias("stored_at")), 259200)


_ALIAS = "json_extract_string(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '$.source_document_id')"
_ASKED = f"SELECT doc_id AS asked, CASE doc_id % 3 WHEN 0 THEN {_ALIAS} WHEN 1 THEN 'DOC' || right({_ALIAS}, 4) ELSE 'FILE00' || substring({_ALIAS}, 2) END AS alias FROM documents WHERE {_ALIAS} IS NOT NULL"


@query(f"WITH a AS ({_ASKED}), r AS (SELECT doc_id, printf('D%05d', doc_id) AS name FROM documents), e AS (SELECT asked, doc_id FROM a JOIN r ON alias = name), n AS (SELECT asked, r.doc_id FROM a JOIN r ON regexp_extract(alias, '(\\d+)$', 1)::BIGINT = regexp_extract(name, '(\\d+)$', 1)::BIGINT WHERE alias NOT IN (SELECT name FROM r)) SELECT asked, doc_id, 'id' AS matched_by FROM e UNION ALL SELECT asked, doc_id, 'number' FROM n")
def document_alias(spark, d):
    """JOIN-10: aliases of the metadata joined with documents by id, else by the number they end in."""
    docs = table(spark, d, "documents")
    alias = F.get_json_object("metadata_json", "$.source_document_id")
    ok = F.from_json("metadata_json", "struct<source_document_id:string>").getField("source_document_id").isNotNull()
    a = docs.where(ok).select(F.col("doc_id").alias("asked"), alias.alias("x"))
    form = F.when(F.col("asked") % 3 == 0, F.col("x")).when(F.col("asked") % 3 == 1, F.concat(F.lit("DOC"), F.right("x", F.lit(4)))).otherwise(F.concat(F.lit("FILE00"), F.expr("substring(x, 2)")))
    return L.by_id_or_number(a.select("asked", form.alias("alias")), docs.select("doc_id", F.format_string("D%05d", "doc_id").alias("name")), "alias", "name", ["asked", "doc_id"])


@query(
    "WITH n AS (SELECT count(*) AS n FROM documents), h AS (SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT (SELECT least(60, greatest(n // 5, 1)) FROM n)), "
    "r AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY md5('43-' || doc_id)) - 1) % 5 AS fold FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)) SELECT doc_id, source, fold::INT AS fold FROM r UNION ALL SELECT doc_id, source, NULL FROM documents WHERE doc_id IN (SELECT doc_id FROM h)"
)
def stratified_folds(spark, d):
    """EVL-01: seeded hold-out and five folds stratified by profile (here the source)."""
    return C.folds(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source")


_REL = f"k AS (SELECT doc_id, pos, keyword, regexp_replace(lower(keyword), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') AS f FROM ({_KW}) WHERE keyword IS NOT NULL), g AS (SELECT DISTINCT a.doc_id, a.keyword AS head, CASE a.doc_id % 2 WHEN 0 THEN 'improves' ELSE 'uses' END AS relation, b.keyword AS tail FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1), e AS (SELECT DISTINCT doc_id, f FROM k)"


@query(
    f"WITH {_REL}, p AS (SELECT DISTINCT a.doc_id, upper(a.keyword) AS head, CASE a.doc_id % 4 WHEN 1 THEN 'needs' ELSE 'improves it; uses' END AS relation, b.keyword || ' set' AS tail FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0), "
    "q AS (SELECT doc_id, regexp_replace(lower(relation), '[^a-z0-9]+', '', 'g') AS pr, regexp_replace(lower(head), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') AS ph, regexp_replace(lower(tail), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') AS pt FROM p), "
    "gg AS (SELECT *, regexp_replace(lower(head), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') AS gh, regexp_replace(lower(tail), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') AS gt FROM g) "
    "SELECT DISTINCT gg.doc_id, gg.head, gg.relation, gg.tail FROM gg JOIN q USING (doc_id) WHERE (contains(pr, relation) OR contains(relation, pr)) AND length(ph) >= 2 AND length(pt) >= 2 AND gh <> '' AND gt <> '' AND (contains(ph, gh) OR contains(gh, ph)) AND (contains(pt, gt) OR contains(gt, pt))"
)
def relation_matches(spark, d):
    """JOIN-20: gold relations matched by predictions with other wording."""
    k = keywords.of_metadata(table(spark, d, "documents")).where("keyword IS NOT NULL").select("doc_id", "pos", "keyword")
    after = k.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("keyword").alias("next"))
    j = k.join(after, ["doc_id", "pos"])
    gold = j.select("doc_id", F.col("keyword").alias("head"), F.when(F.col("doc_id") % 2 == 0, "improves").otherwise("uses").alias("relation"), F.col("next").alias("tail")).distinct()
    pred = j.where("pos % 2 = 0").select("doc_id", F.upper("keyword").alias("head"), F.when(F.col("doc_id") % 4 == 1, "needs").otherwise("improves it; uses").alias("relation"), F.concat("next", F.lit(" set")).alias("tail")).distinct()
    return C.matched_relations(gold, pred, k.select("doc_id", F.col("keyword").alias("canonical"), F.col("keyword").alias("variant")).distinct())


@query(
    f"WITH c AS ({_CENT}), s AS (SELECT e.vec_id, e.label, c.label AS k, round(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 6) AS s FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) - 1 AS place FROM s), "
    "o AS (SELECT vec_id, label, place, s FROM r WHERE k = label AND place < 6) SELECT e.vec_id, round(CASE WHEN o.place IS NULL THEN 0.85 ELSE least(0.95, 0.85 + greatest(0, 0.10 - place * 0.02) + greatest(0, s - 0.5)) END::DOUBLE, 3) AS confidence FROM embeddings e LEFT JOIN o USING (vec_id)"
)
def domain_confidence(spark, d):
    """RES-21: confidence of the chosen class by its place and similarity among the six best."""
    e = table(spark, d, "embeddings")
    near = X.ranked_centroids(e, X.centroids(e, "label"), "label", 6)
    return near.select("vec_id", C.domain_confidence(F.col("label"), F.col("candidates")).alias("confidence"))


_TAX = "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'TP391' WHEN 1 THEN 'TM7' ELSE 'R5' END AS gold, CASE p_partkey % 5 WHEN 0 THEN 'TP391' WHEN 1 THEN 'TM71' WHEN 2 THEN 'R5' WHEN 3 THEN 'TP3' ELSE 'X' END AS pred, CASE p_size % 4 WHEN 0 THEN 'R73' WHEN 1 THEN 'TP3' END AS gold_aux, CASE p_partkey % 3 WHEN 0 THEN 'R73' WHEN 1 THEN 'TM7' END AS pred_aux FROM part"
_D = "CASE WHEN left({0}, 1) = 'T' THEN left({0}, 2) ELSE left({0}, 1) END"


@query(
    f"WITH t AS (SELECT *, pred <> 'X' AS known, coalesce({_D.format('gold')} <> {_D.format('gold_aux')}, false) AS g, coalesce({_D.format('pred')} <> {_D.format('pred_aux')}, false) AS p FROM ({_TAX})), c AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM t) "
    f"SELECT count(*) AS n, round(avg((gold = pred)::INT), 6) AS exact, round(avg((starts_with(gold, pred) OR starts_with(pred, gold))::INT), 6) AS branch, round(avg(({_D.format('gold')} = {_D.format('pred')})::INT), 6) AS discipline, round(avg((left(gold, 1) = left(pred, 1))::INT), 6) AS top, round(avg(coalesce(gold_aux = pred_aux, false)::INT), 6) AS aux, "
    "round(max(tp / (tp + fp)::DOUBLE), 6) AS inter_precision, round(max(tp / (tp + fn)::DOUBLE), 6) AS inter_recall, round(max(2 * tp / (2 * tp + fp + fn)::DOUBLE), 6) AS inter_f1, round(avg(known::INT), 6) AS existing FROM t, c"
)
def taxonomy_scores(spark, d):
    """AGG-22: the seven measures of taxonomy accuracy."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda n, xs: F.get(F.array(*(F.lit(x) for x in xs)), n.cast("int"))
    r = table(spark, d, "part").select(pick(s % 3, ("TP391", "TM7", "R5")).alias("gold"), pick(k % 5, ("TP391", "TM71", "R5", "TP3", "X")).alias("pred"), pick(s % 4, ("R73", "TP3")).alias("gold_aux"), pick(k % 3, ("R73", "TM7")).alias("pred_aux"))
    return C.taxonomy_scores(r.withColumn("known", F.col("pred") != "X"))


_GP = f"SELECT doc_id, list_distinct(list_transform(k, lambda x: lower(x))) AS gold, list_slice(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{{4,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,4}}'), 1, 8) AS p FROM (SELECT doc_id, title, from_json(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '{{\"keywords\": [\"VARCHAR\"]}}').keywords AS k FROM documents) WHERE len(k) > 0"


@query(
    f"WITH a AS ({_GP}), b AS (SELECT doc_id, gold, list_filter(p, lambda x, i: list_position(p, x) = i) AS pred FROM a), c AS (SELECT *, len(list_intersect(gold, pred)) AS hit, len(list_filter(pred, lambda x: len(list_filter(gold, lambda y: contains(x, y) OR contains(y, x))) > 0)) AS hp, len(list_filter(gold, lambda x: len(list_filter(pred, lambda y: contains(x, y) OR contains(y, x))) > 0)) AS hg FROM b), "
    "r AS (SELECT CASE WHEN len(pred) = 0 THEN 0 ELSE hit / len(pred)::DOUBLE END AS p, hit / len(gold)::DOUBLE AS r, CASE WHEN len(pred) = 0 THEN 0 ELSE hp / len(pred)::DOUBLE END AS pp, hg / len(gold)::DOUBLE AS pr, len(list_intersect(gold, list_slice(pred, 1, 5))) / len(gold)::DOUBLE AS rk FROM c) "
    "SELECT count(*) AS docs, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS f1, round(avg(pp), 6) AS partial_precision, round(avg(pr), 6) AS partial_recall, round(avg(CASE WHEN pp + pr = 0 THEN 0 ELSE 2 * pp * pr / (pp + pr) END), 6) AS partial_f1, round(avg(rk), 6) AS recall_at_k FROM r"
)
def keyword_scores(spark, d):
    """AGG-19: exact and partial scores of title words against the stored keywords."""
    k = F.from_json("metadata_json", "struct<keywords:array<string>>").getField("keywords")
    words = F.slice(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(r"[a-z]{4,}|[\x{4e00}-\x{9fff}]{2,4}"), 0), 1, 8)
    r = table(spark, d, "documents").select("doc_id", F.array_distinct(F.transform(k, F.lower)).alias("gold"), F.array_distinct(words).alias("pred")).where(F.size("gold") > 0)
    return C.keyword_scores(r)


_EV = "SELECT p_mfgr_or AS split, p_brand AS label, p_size % 2 = 0 AS top1, p_size % 5 <> 0 AS top5, p_size % 4 AS tp, p_partkey % 3 AS fp, p_partkey % 2 AS fn, p_size <= 40 AS fits FROM (SELECT *, split_part(p_type, ' ', 1) AS p_mfgr_or FROM part)"


@query(
    f"WITH e AS ({_EV}), b AS (SELECT * FROM e UNION ALL SELECT * REPLACE ('all' AS split) FROM e) SELECT split, count(*) AS clusters, round(sum(top1::INT) / count(*), 6) AS top1, round(sum(top5::INT) / count(*), 6) AS recall_at_5, round(sum(tp) / greatest(sum(tp) + sum(fp), 1), 6) AS precision, round(sum(tp) / greatest(sum(tp) + sum(fn), 1), 6) AS recall, "
    "round(2 * sum(tp) / greatest(2 * sum(tp) + sum(fp) + sum(fn), 1), 6) AS f1, round(sum(fits::INT) / count(*), 6) AS length, round((count(*) - count(DISTINCT label)) / count(*), 6) AS repeated FROM b GROUP BY split"
)
def label_evaluation(spark, d):
    """AGG-20: label evaluation overall and by split, in one pass over the rows."""
    s, k = F.col("p_size"), F.col("p_partkey")
    r = table(spark, d, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("split"), F.col("p_brand").alias("label"), (s % 2 == 0).alias("top1"), (s % 5 != 0).alias("top5"), (s % 4).alias("tp"), (k % 3).alias("fp"), (k % 2).alias("fn"), (s <= 40).alias("fits"))
    return C.label_evaluation(r)


@query(
    f"WITH x AS ({rules.scoring_sql(sents('abstract_text'))}), m(l) AS (VALUES {', '.join(f'({m!r})' for m in rules.MOVES)}), f AS (SELECT l, count(*) FILTER (label = l AND suggestion = l) AS tp, count(*) FILTER (label = l) + count(*) FILTER (suggestion = l) AS s FROM m, x GROUP BY l) "
    "SELECT (SELECT count(*) FROM x) AS n, (SELECT round(avg((label = suggestion)::INT), 6) FROM x) AS accuracy, round(sum(CASE WHEN s = 0 THEN 0 ELSE 2 * tp / s::DOUBLE END) / 5, 6) AS macro_f1 FROM f"
)
def move_macro_scores(spark, d):
    """AGG-18: accuracy and macro F1 of suggested moves over the fixed list of moves."""
    s = rules.score(labelled_rows(table(spark, d, "documents"), "abstract_text"), rules.RULES)
    return C.macro_scores(s.select(F.col("label").alias("gold"), F.col("suggestion").alias("pred")), rules.MOVES)


_OT = "SELECT l_orderkey AS doc_id, CASE l_linestatus WHEN 'O' THEN l_shipmode_or END AS type, l_linenumber AS id, l_discount * 8 AS fitness, l_tax > 0.07 AS in_dictionary FROM (SELECT *, l_returnflag AS l_shipmode_or FROM lineitem)"


@query(f"WITH r AS ({_OT}), f AS (SELECT * FROM r WHERE NOT in_dictionary AND type IS NOT NULL AND fitness >= 0.40), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY fitness DESC, id) AS place, max(fitness) OVER (PARTITION BY doc_id, type) AS top FROM f) SELECT doc_id, type, id, fitness, in_dictionary FROM w WHERE place = 1 OR (place = 2 AND fitness >= top - 0.15) UNION ALL SELECT * FROM r WHERE in_dictionary OR type IS NULL")
def dynamic_one_or_two(spark, d):
    """WIN-06: best of every type and a near second one; dictionary rows always stay."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("type"), F.col("l_linenumber").alias("id"), (F.col("l_discount") * 8).alias("fitness"), (F.col("l_tax") > 0.07).alias("in_dictionary"))
    return C.one_or_two(r, ["doc_id", "type"])


_MK = "[\\[［]\\s*\\d+(?:\\s*[-–,，]\\s*\\d+)*\\s*[\\]］]"


@query(
    f"WITH s AS ({sents('content_text')}), f AS (SELECT doc_id, idx, sentence || CASE idx % 9 WHEN 0 THEN ' ModelDescription' WHEN 1 THEN ' VCDN [1] 98.6 [2] 7' ELSE '' END AS s FROM s), g AS (SELECT *, regexp_replace(s, '\\s+', '', 'g') AS t FROM f) "
    f"SELECT doc_id, idx FROM g WHERE len(regexp_extract_all(t, '\\d{{1,3}}\\.\\d{{3,}}')) >= 2 OR len(regexp_extract_all(t, '[\\]］]\\d')) >= 2 OR regexp_matches(s, '\\\\mathrm|\\\\left\\s*\\[|\\\\right\\s*\\]|\\$\\{{') OR (contains(t, '一一') AND regexp_matches(t, '[\\[［]\\d')) OR (len(regexp_extract_all(s, '{_MK}')) >= 5 AND length(s) >= 250) OR regexp_matches(t, '(Model|Method|Dataset|Approach|Framework)(Description|Features|Data|Used)')"
)
def residue_lines(spark, d):
    """FLT-07: sentences that are what is left of tables and formulas."""
    s = sentence_rows(table(spark, d, "documents"), "content_text")
    more = F.when(F.col("idx") % 9 == 0, " ModelDescription").when(F.col("idx") % 9 == 1, " VCDN [1] 98.6 [2] 7").otherwise("")
    return s.where(C.residue_line(F.concat("sentence", more))).select("doc_id", "idx")


@query("WITH s AS (SELECT id AS document_id, CASE WHEN doc_id % 4 = 0 THEN source END AS label FROM documents), l AS (SELECT DISTINCT document_id, 'c' || length(document_id) AS category FROM collection_documents) SELECT s.document_id, l.category AS label, 'joined' AS how FROM s JOIN l USING (document_id) WHERE s.label IS NULL UNION ALL SELECT document_id, label, 'own' FROM s WHERE label IS NOT NULL")
def labelled_samples(spark, d):
    """JOIN-05: samples with the label of their document, and those with one of their own."""
    s = table(spark, d, "documents").select(F.col("id").alias("document_id"), F.when(F.col("doc_id") % 4 == 0, F.col("source")).alias("label"))
    labels = table(spark, d, "collection_documents").select("document_id", F.concat(F.lit("c"), F.char_length("document_id").cast("string")).alias("category"))
    return C.joined_rollup(s, labels)


@query(f"{extract._SPANS} SELECT doc_id, type, arg_min(entity, {{'s': start_pos, 'e': entity}}) AS entity, count(*) AS forms FROM spans GROUP BY doc_id, type")
def first_by_type(spark, d):
    """RES-03: of the entities of one type and standard name the first stays (here one name a type)."""
    spans = extract.scan_lexicon(table(spark, d, "documents"), "abstract_text", extract.LEXICON)
    return spans.groupBy("doc_id", "type").agg(F.min_by("entity", F.struct("start_pos", "entity")).alias("entity"), F.count("*").alias("forms"))
