"""Queries on cluster labels and cluster quality. Vectors stand for encoded phrases, labels for clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions import vectors as V
from strataloom.operators import keywords
from strataloom.operators import labelling as L
from strataloom.operators import results as R
from strataloom.operators import vectors as X
from strataloom.plans.q_vectors import _CENT
from strataloom.plans.registry import registry
from strataloom.session import table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)

NEAR, FAR = 0.05, 0.88  # the test vectors of a cluster are farther apart than phrases
_U = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"
_PH = f"""p AS (SELECT *, weight * ln(1 + frequency) / log2(rank + 2) AS w FROM (SELECT label AS cluster_id, 'phrase ' || vec_id AS text, 1 / (1 + vec_id % 5)::DOUBLE AS weight, vec_id % 7 + 1 AS frequency,
row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rank, {_U.format('embedding::DOUBLE[]')} AS v, vec_id FROM embeddings))"""
_MEAN = _PH + """, mean AS (SELECT cluster_id, list(m ORDER BY dim) AS mean FROM (SELECT cluster_id, i AS dim, sum(v[i] * w) / sum(w) AS m FROM p, unnest(range(1, 65)) AS r(i) GROUP BY ALL) GROUP BY cluster_id),
cen AS (SELECT cluster_id, mean, list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) AS centre FROM mean)"""


def _phrases(spark, d):
    e = table(spark, d, "embeddings")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("cluster_id"), F.concat(F.lit("phrase "), F.col("vec_id").cast("string")).alias("text"), (1 / (1 + F.col("vec_id") % 5)).alias("weight"), (F.col("vec_id") % 7 + 1).alias("frequency"), rank.alias("rank"), F.col("embedding").alias("vector"), "vec_id")


@query(f"WITH {_MEAN} SELECT cluster_id, list_transform(centre, lambda x: round(x, 5)) AS centre FROM cen")
def phrase_centres(spark, d):
    """RES-29: phrase-weighted centre of every cluster."""
    return L.phrase_centres(_phrases(spark, d)).select("cluster_id", V.rounded(F.col("centre"), 5).alias("centre"))


@query(
    f"WITH {_MEAN}, one AS (SELECT cluster_id, vec_id // 3 AS doc_id, arg_min(v, vec_id) AS v FROM p WHERE cluster_id <> 3 GROUP BY ALL), dm AS (SELECT cluster_id, list(m ORDER BY dim) AS of_documents FROM (SELECT cluster_id, i AS dim, avg(v[i]) AS m FROM one, unnest(range(1, 65)) AS r(i) GROUP BY ALL) GROUP BY cluster_id) "
    "SELECT cluster_id, list_transform(coalesce(of_documents, centre), lambda x: round(x, 5)) AS centre, of_documents IS NOT NULL AS from_documents FROM cen LEFT JOIN dm USING (cluster_id)"
)
def evidence_centres(spark, d):
    """RES-43: centres from one sentence of each document, else from phrases."""
    p = _phrases(spark, d)
    s = p.where("cluster_id <> 3").select("cluster_id", F.expr("vec_id div 3").alias("doc_id"), F.col("vec_id").alias("place"), "vector")
    return L.evidence_centres(s, p).withColumn("centre", V.rounded(F.col("centre"), 5))


_CAND = f"""t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(w, 9) DESC, lower(text), text) AS place FROM p QUALIFY place <= 8),
pr AS (SELECT a.cluster_id, a.text || ' and ' || b.text AS label, (a.w + b.w) / 2 AS source, list_dot_product(a.v, b.v) AS alike, list_transform(list_zip(a.v, b.v), lambda z: z[1] + z[2]) AS s FROM t a JOIN t b ON a.cluster_id = b.cluster_id AND a.place < b.place AND a.place <= 6 AND b.place <= 6),
cand AS (SELECT cluster_id, text AS label, 'phrase' AS origin, w AS source, 1 AS evidence, 0.0::DOUBLE AS diversity, v FROM t UNION ALL SELECT cluster_id, label, 'pair', source, 2, greatest(0, least(1, (0.88 - alike) / 0.53)), {_U.format('s')} FROM pr WHERE alike BETWEEN {NEAR} AND {FAR})"""


@query(f"WITH {_PH}, {_CAND} SELECT cluster_id, label, origin, round(source, 6) AS source FROM cand")
def local_candidates(spark, d):
    """RES-30: best phrases and pairs of phrases of every cluster."""
    return L.local_candidates(_phrases(spark, d), NEAR, FAR).select("cluster_id", "label", "origin", F.round("source", 6).alias("source"))


@query(
    f"""WITH {_MEAN}, {_CAND}, cov AS (SELECT c.cluster_id, c.label, sum(p.w * least(greatest((list_dot_product(c.v, p.v) + 1) / 2, 0), 1)) / sum(p.w) AS coverage FROM cand c JOIN p USING (cluster_id) GROUP BY ALL),
    x AS (SELECT c.*, coverage, (SELECT list_dot_product(c.v, n.centre) FROM cen n WHERE n.cluster_id = c.cluster_id) AS own, (SELECT max(list_dot_product(c.v, n.centre)) FROM cen n WHERE n.cluster_id <> c.cluster_id) AS other, max(source) OVER (PARTITION BY c.cluster_id) AS top, len(string_split(c.label, ' ')) AS n FROM cand c JOIN cov USING (cluster_id, label))
    SELECT cluster_id, label, origin, round(0.38 * (own + 1) / 2 + 0.24 * coverage + 0.16 * source / top + 0.10 / (1 + exp(-6 * (own - coalesce(other, -1)))) + 0.08 * least(1, n / 2.0, 8.0 / n) + 0.04 * diversity, 6) AS score, CASE WHEN n > 8 THEN ['too long'] ELSE [] END AS rejected FROM x"""
)
def label_scores(spark, d):
    """RES-31, LAB-03: scores of label candidates; the SQL takes coverage over all pairs, the operator from the weighted mean."""
    p = _phrases(spark, d)
    return L.scored_candidates(L.local_candidates(p, NEAR, FAR), L.phrase_centres(p))


@query(
    f"""WITH e AS (SELECT vec_id, label, {_U.format('embedding::DOUBLE[]')} AS v FROM embeddings), s AS (SELECT label, max(n) AS n, list(m ORDER BY dim) AS c FROM (SELECT label, i AS dim, avg(v[i]) AS m, count(*) AS n FROM e, unnest(range(1, 65)) AS r(i) GROUP BY ALL) GROUP BY label),
    ab AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id <> b.vec_id THEN list_dot_product(a.v, b.v) END) AS dots, avg(1 - list_dot_product(a.v, b.v)) FILTER (a.vec_id <> b.vec_id) AS far FROM e a JOIN e b ON true GROUP BY ALL),
    si AS (SELECT vec_id, label, min(far) FILTER (other = label) AS a, min(far) FILTER (other <> label) AS b, max(dots) FILTER (other = label) AS dots FROM ab GROUP BY ALL),
    q AS (SELECT label, count(*) AS size, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette, sum(dots) AS pairs FROM si GROUP BY label)
    SELECT q.label, size, round(CASE WHEN size > 1 THEN pairs / (size * (size - 1)) END, 5) AS pairwise, round((SELECT avg(list_dot_product(e.v, s.c)) FROM e JOIN s ON e.label = s.label WHERE e.label = q.label) - coalesce((SELECT min(list_dot_product(x.c, y.c)) FROM s x, s y WHERE x.label = q.label AND y.label <> q.label), 0), 5) AS separation, round(silhouette, 5) AS silhouette FROM q"""
)
def cluster_quality(spark, d):
    """AGG-15, AGG-16: pairwise mean, separation and silhouette; the SQL forms all pairs."""
    return L.cluster_quality(table(spark, d, "embeddings"), "label", "embedding")


_TERMS = "t AS (SELECT workspace_id AS cluster_id, doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z][a-z0-9-]{2,}'))) AS term FROM documents)"


@query(
    f"WITH {_TERMS}, k AS (SELECT count(DISTINCT doc_id) AS docs FROM t), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1), c AS (SELECT cluster_id, term, count(*) AS n FROM t GROUP BY ALL), "
    "s AS (SELECT c.cluster_id, term, n, round(n * (ln((docs + 1) / (df + 1)::DOUBLE) + 1) * CASE WHEN EXISTS (SELECT 1 FROM c b WHERE b.cluster_id = c.cluster_id AND b.term <> c.term AND contains(b.term, c.term)) THEN 0.5 ELSE 1 END, 6) AS score FROM c JOIN df USING (term), k) "
    "SELECT cluster_id, arg_max(term, {'a': score, 'b': n, 'c': length(term), 'd': term}) AS label, max(score) AS score FROM s GROUP BY cluster_id"
)
def cluster_label_terms(spark, d):
    """AGG-13: the best title term of every workspace, terms within others halved."""
    t = table(spark, d, "documents").select(F.col("workspace_id").alias("cluster_id"), "doc_id", F.explode(T.latin_terms(F.col("title"))).alias("term"))
    return L.cluster_label_terms(t.withColumn("n", F.lit(1)))


def _greedy(limit: int) -> str:
    out, last = [], "s"
    for i in range(1, limit + 1):
        out.append(f"b{i} AS (SELECT cluster_id, arg_max(term, {{'a': score, 'b': kw, 'c': length(term), 'd': term}}) AS chosen, max(score) AS score FROM {last} GROUP BY 1)")
        out.append(f"l{i} AS (SELECT x.* FROM {last} x JOIN b{i} ON x.cluster_id = b{i}.cluster_id WHERE NOT contains(term, chosen) AND NOT contains(chosen, term))")
        last = f"l{i}"
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT cluster_id, {i} AS place, chosen AS term, score FROM b{i}" for i in range(1, limit + 1))


@query(
    f"WITH {_TERMS}, kw AS (SELECT x.workspace_id AS cluster_id, m.doc_id, lower(keyword) AS term FROM ({keywords._META_SQL}) m JOIN documents x USING (doc_id) WHERE keyword IS NOT NULL), a AS (SELECT cluster_id, doc_id, term, max(k) AS k FROM (SELECT *, 0 AS k FROM t UNION ALL SELECT *, 1 FROM kw) GROUP BY ALL), "
    "n AS (SELECT count(DISTINCT doc_id) AS docs FROM a), df AS (SELECT term, count(*) AS df FROM a GROUP BY 1), c AS (SELECT cluster_id, term, count(*) AS freq, sum(k)::BIGINT AS kw FROM a WHERE length(term) BETWEEN 2 AND 24 GROUP BY ALL), "
    f"s AS (SELECT cluster_id, term, kw, round(freq * (ln((1 + docs) / (1 + df)::DOUBLE) + 1) + 2.5 * kw, 6) AS score FROM c JOIN df USING (term), n), {_greedy(6)}"
)
def representative_terms(spark, d):
    """AGG-12: six terms of every workspace from titles and keywords, none within another."""
    docs = table(spark, d, "documents")
    t = docs.select(F.col("workspace_id").alias("cluster_id"), "doc_id", F.explode(T.latin_terms(F.col("title"))).alias("term"), F.lit(False).alias("keyword"))
    k = keywords.of_metadata(docs).where("keyword IS NOT NULL").select("doc_id", F.lower("keyword").alias("term"), F.lit(True).alias("keyword")).join(docs.select("doc_id", F.col("workspace_id").alias("cluster_id")), "doc_id")
    return L.representative_terms(t.unionByName(k).groupBy("cluster_id", "doc_id", "term").agg(F.max("keyword").alias("keyword")))


@query(
    f"WITH c AS ({_CENT}), s AS (SELECT label, avg(list_distance(e.embedding::DOUBLE[], c.centroid)) AS s FROM embeddings e JOIN c USING (label) GROUP BY label), r AS (SELECT a.label, max((a.s + b.s) / list_distance(ca.centroid, cb.centroid)) AS w FROM s a JOIN s b ON a.label <> b.label JOIN c ca ON ca.label = a.label JOIN c cb ON cb.label = b.label GROUP BY a.label) SELECT count(*) AS clusters, round(avg(w), 5) AS davies_bouldin FROM r"
)
def davies_bouldin(spark, d):
    """AGG-16: Davies-Bouldin index of the labelled vectors."""
    e = table(spark, d, "embeddings")
    return L.davies_bouldin(e, "label", X.centroids(e, "label"), "embedding")


_HAN = "[\\x{4e00}-\\x{9fff}]"
_GRAMS = lambda n: f"flatten(list_transform(regexp_extract_all(coalesce(title, ''), '{_HAN}{{{n},}}'), lambda r: list_transform(range(1, length(r) - {n} + 2), lambda i: substring(r, i, {n}))))"


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(title, '')), '[a-z][a-z0-9-]{{2,}}') || {' || '.join(_GRAMS(n) for n in range(2, 7))} AS terms FROM documents) SELECT doc_id, list_sort(list_distinct(terms)) AS terms FROM t")
def title_terms(spark, d):
    """STR-14: Latin tokens and Chinese n-grams of the titles."""
    return table(spark, d, "documents").select("doc_id", F.array_sort(T.all_terms(F.col("title"))).alias("terms"))


@query(
    f"WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z]+'), lambda w: w NOT IN ({', '.join(repr(x) for x in keywords.STOP)})) AS w, {_GRAMS(2)} AS g FROM documents) "
    "SELECT doc_id, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^.{2,}ies$') THEN regexp_replace(x, 'ies$', 'y') WHEN regexp_matches(x, '^.+(ss|x|ch|sh)es$') THEN regexp_replace(x, 'es$', '') WHEN regexp_matches(x, '^.{2,}[^s]s$') THEN regexp_replace(x, 's$', '') ELSE x END) || g AS words FROM w"
)
def title_words(spark, d):
    """STR-13: words of the titles in the singular and Chinese bigrams."""
    return table(spark, d, "documents").select("doc_id", T.label_words(F.col("title"), keywords.STOP).alias("words"))


@query("SELECT doc_id, lang AS label FROM documents WHERE lang IS NOT NULL AND lang <> 'und'")
def legal_labels(spark, d):
    """RES-12: labels that must all be legal (an error otherwise)."""
    rows = table(spark, d, "documents").where("lang IS NOT NULL AND lang <> 'und'").select("doc_id", F.col("lang").alias("label"))
    return R.legal_labels(rows, ("en", "zh", "de", "fr", "es", "pt", "ja", "ru", "ko", "th"))
