"""Queries on the refinement of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import extract, keywords, rules, taxonomy
from strataloom.operators import refine as R
from strataloom.operators.keywords import GENERIC, STOP
from strataloom.plans import q_similarity as Q
from strataloom.plans.q_text import labelled_rows, sents
from strataloom.plans.registry import registry
from strataloom.session import table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)

_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_RAW = f"SELECT doc_id, pos, CASE pos % 7 WHEN 3 THEN keyword || ' (x).' WHEN 4 THEN 'Fig. ' || pos WHEN 5 THEN split_part(keyword, ' ', 1) ELSE keyword END AS keyword, coalesce(abstract_text, '') AS text FROM ({keywords._META_SQL}) WHERE keyword IS NOT NULL"
_EDGE = R.EDGES


@query(
    f"""WITH r AS ({_RAW}), a AS (SELECT *, regexp_replace(keyword, '{_EDGE}', '', 'g') AS e FROM r), b AS (SELECT *, CASE WHEN NOT contains(e, '(') THEN e WHEN length(trim(split_part(e, '(', 1))) >= length(trim(replace(regexp_extract(e, '\\((.*)$', 1), ')', ''))) AND trim(split_part(e, '(', 1)) <> '' THEN trim(split_part(e, '(', 1)) ELSE trim(replace(regexp_extract(e, '\\((.*)$', 1), ')', '')) END AS k FROM a),
    c AS (SELECT *, lower(k) AS low, regexp_matches(k, '^[\\x00-\\x7f]*$') AS en, len(string_split_regex(k, '\\s+')) AS w, regexp_matches(k, '^[A-Z0-9]*[A-Z][A-Z0-9]*$') AS caps FROM b),
    d AS (SELECT *, CASE WHEN k = '' THEN 'empty' WHEN regexp_matches(k, '{R.JUNK}') THEN 'junk' WHEN en AND NOT (w BETWEEN 1 AND 8 AND length(k) BETWEEN 2 AND 60) THEN 'length' WHEN NOT en AND NOT length(k) BETWEEN 2 AND 24 THEN 'length' WHEN low IN ({_IN(STOP)}) THEN 'function_word'
    WHEN en AND length(k) <= 2 AND NOT caps THEN 'fragment' WHEN en AND caps AND length(k) <= 3 AND k NOT IN ({_IN(R.ACRONYMS)}) THEN 'fragment' WHEN en AND w = 1 AND length(k) <= 5 AND text <> '' AND NOT regexp_matches(lower(text), '(^|[^a-z])' || regexp_replace(low, '[^a-z0-9]', '.', 'g') || '([^a-z]|$)') THEN 'not_a_word' END AS r1 FROM c),
    f AS (SELECT *, coalesce(r1, CASE WHEN low IN ({_IN(GENERIC)}) AND EXISTS (SELECT 1 FROM d y WHERE y.doc_id = d.doc_id AND y.low <> d.low AND list_contains(string_split_regex(y.low, '\\s+'), d.low)) THEN 'generic' END, CASE WHEN EXISTS (SELECT 1 FROM d y WHERE y.doc_id = d.doc_id AND y.r1 IS NULL AND y.low = d.low AND y.pos < d.pos) THEN 'repeated' END) AS r2 FROM d)
    SELECT doc_id, pos, keyword, k AS term, coalesce(r2, CASE WHEN EXISTS (SELECT 1 FROM f y WHERE y.doc_id = f.doc_id AND y.r2 IS NULL AND y.k <> f.k AND contains(f.k, y.k)) THEN 'holds_base' END) AS reason FROM f"""
)
def filtered_keywords(spark, d):
    """FLT-05/06, SET-06: keywords with the reasons that drop them (some made worse on purpose)."""
    k = keywords.of_metadata(table(spark, d, "documents")).where("keyword IS NOT NULL")
    p = F.col("pos") % 7
    worse = F.when(p == 3, F.concat("keyword", F.lit(" (x)."))).when(p == 4, F.concat(F.lit("Fig. "), F.col("pos").cast("string"))).when(p == 5, F.split_part("keyword", F.lit(" "), F.lit(1))).otherwise(F.col("keyword"))
    return R.filtered_keywords(k.select("doc_id", "pos", worse.alias("keyword"), F.col("abstract_text").alias("text")))


_FOLDS = rules.scoring_sql(sents("abstract_text"))


@query(
    f"""WITH x AS ({_FOLDS}), m AS (SELECT doc_id % 5 AS fold, suggestion AS rule, CASE suggestion WHEN 'purpose' THEN 'early' WHEN 'background' THEN 'early' ELSE suggestion END AS signature, CASE WHEN suggestion = 'method' THEN 'candidate' ELSE 'soft' END AS level, (label = suggestion)::INT AS ok FROM x),
    p AS (SELECT fold, rule, signature, level, count(*) AS matched, sum(ok) AS correct, sum(1 - ok) AS incorrect FROM m GROUP BY ALL), g AS (SELECT rule, signature, count(DISTINCT fold) AS folds, arg_max(level, fold) AS lv, sum(matched)::BIGINT AS matched, sum(correct)::BIGINT AS correct, sum(incorrect)::BIGINT AS incorrect FROM p GROUP BY ALL)
    SELECT signature, rule, folds, CASE WHEN folds >= 3 AND correct - incorrect >= 2 AND lv IN ('soft', 'strong') THEN 'strong' WHEN folds >= 2 AND correct - incorrect >= 1 THEN 'soft' ELSE 'advisory' END AS level, matched, correct, incorrect, correct - incorrect AS net_gain, round((correct + 1) / (correct + incorrect + 2)::DOUBLE, 6) AS reliability FROM g QUALIFY row_number() OVER (PARTITION BY signature ORDER BY folds DESC, rule) = 1"""
)
def rules_over_folds(spark, d):
    """AGG-24: suggestions of moves over five folds of documents, summed, levelled and deduplicated."""
    s = rules.score(labelled_rows(table(spark, d, "documents"), "abstract_text"), rules.RULES)
    early = F.when(F.col("suggestion").isin("purpose", "background"), "early").otherwise(F.col("suggestion"))
    ok = (F.col("label") == F.col("suggestion")).cast("int")
    p = s.groupBy((F.col("doc_id") % 5).alias("fold"), F.col("suggestion").alias("rule")).agg(F.first(early).alias("signature"), F.count("*").alias("matched"), F.sum(ok).alias("correct"), F.sum(1 - ok).alias("incorrect"))
    return R.rules_over_folds(p.withColumn("level", F.when(F.col("rule") == "method", "candidate").otherwise("soft")))


@query(
    extract._SPANS + ", r AS (SELECT DISTINCT doc_id, hash_group AS g, entity FROM (SELECT doc_id, entity, md5(entity) AS hash_group FROM spans WHERE type = 'method')), lk AS (SELECT DISTINCT r.g AS a, f.g AS b FROM r JOIN (SELECT doc_id, min(g) AS g FROM r GROUP BY 1) f USING (doc_id)), "
    "e AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk) SELECT seat, count(DISTINCT doc_id) AS docs, arg_max(entity, {'n': length(entity), 'm': entity}) AS method FROM r JOIN (WITH RECURSIVE c(node, c) AS (SELECT a, a FROM e UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.node) SELECT node, min(c) AS seat FROM c GROUP BY node) s ON r.g = s.node GROUP BY seat"
)
def method_seats(spark, d):
    """REV-03, RES-22: method groups that share a document, merged."""
    m = extract.scan_lexicon(table(spark, d, "documents"), "abstract_text", extract.LEXICON).where("type = 'method'")
    return R.method_seats(m.select("doc_id", F.md5("entity").alias("group"), F.col("entity").alias("method")))


@query(
    "WITH t AS (SELECT 'R' || r_regionkey AS code, NULL AS parent FROM region UNION ALL SELECT 'R' || n_regionkey || 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || n_regionkey || 'N' || n_nationkey || 'S' || s_suppkey, 'R' || n_regionkey || 'N' || n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), "
    "a AS (SELECT code FROM t WHERE code NOT LIKE '%S%') SELECT a.code, c.code AS candidate, 'child' AS kind FROM a JOIN t c ON c.parent = a.code UNION ALL SELECT a.code, s.code, 'sibling' FROM a JOIN t x ON x.code = a.code JOIN t s ON s.parent = x.parent AND s.code <> a.code"
)
def refinement_candidates(spark, d):
    """RET-03: siblings and children of the upper codes of the taxonomy."""
    t = taxonomy.tree(table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier"))
    return R.refinement_candidates(t, t.where("NOT contains(code, 'S')"))


@query(
    f"WITH RECURSIVE {Q._EDGES}, b AS (SELECT a AS x, b AS y, s FROM p UNION ALL SELECT b, a, s FROM p), de AS (SELECT x FROM b GROUP BY x HAVING count(*) >= 4), l AS (SELECT x, y FROM b WHERE x IN (SELECT x FROM de) AND y IN (SELECT x FROM de) UNION SELECT x, x FROM de), "
    "c(node, c) AS (SELECT x, x FROM de UNION SELECT l.y, c.c FROM c JOIN l ON l.x = c.node AND l.y > c.c), k AS (SELECT node, min(c) AS cluster FROM c GROUP BY node), o AS (SELECT b.x, arg_max(k.cluster, {'s': round(s, 9), 'y': -CASE WHEN b.y % 5 = 4 THEN b.y - 4 ELSE b.y END}) AS cluster FROM b JOIN k ON b.y = k.node WHERE b.x NOT IN (SELECT x FROM de) GROUP BY b.x) "
    "SELECT u.id, coalesce(k.cluster, o.cluster) AS cluster, coalesce(k.cluster, o.cluster) IS NULL AS noise FROM u LEFT JOIN k ON u.id = k.node LEFT JOIN o ON u.id = o.x"
)
def density_clusters(spark, d):
    """CLU-03: density clusters of all rows, borders to their nearest dense vector, the rest noise."""
    return R.density_clusters(Q._rows(spark, d).select("id", "vector"), 0.84, 4, Q.SURE)
