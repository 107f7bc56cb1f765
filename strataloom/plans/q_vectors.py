"""Queries on embedding vectors. Query rows are those whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions import vectors as V
from strataloom.operators import evaluation as E
from strataloom.operators import vectors as X
from strataloom.plans.registry import registry
from strataloom.session import table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)

_SIM = "round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6)"
_NEAR = f"SELECT q.vec_id AS query_id, r.vec_id AS neighbour, {_SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id"
_CENT = "SELECT label, max(n) AS size, list(m ORDER BY dim) AS centroid FROM (SELECT label, i AS dim, avg(embedding[i]::DOUBLE) AS m, count(*) AS n FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY ALL) GROUP BY label"


@query(f"SELECT * FROM ({_NEAR} WHERE q.vec_id % 50 = 0) WHERE rank <= 10")
def vector_topk(spark, d):
    """TOP-01/02, RET-01: nearest ten vectors of every query."""
    e = table(spark, d, "embeddings")
    return X.top_k(e.where("vec_id % 50 = 0"), e, 10)


@query(
    f"""WITH n AS (SELECT * FROM ({_NEAR}) WHERE rank <= 5), m AS (SELECT a.query_id, a.neighbour, a.similarity, b.query_id IS NOT NULL AS mutual FROM n a LEFT JOIN n b ON a.query_id = b.neighbour AND a.neighbour = b.query_id WHERE a.query_id % 50 = 0)
    SELECT * FROM m WHERE similarity >= 0.4 OR (mutual AND similarity >= 0.25)"""
)
def knn_mutual_pairs(spark, d):
    """JOIN-17/18: alike pairs of queries and neighbours."""
    e = table(spark, d, "embeddings")
    return X.mutual_pairs(e.where("vec_id % 50 = 0"), e, sure=0.4, floor=0.25)  # the test vectors are farther apart than texts


@query(f"SELECT label, size, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM ({_CENT})")
def centroids(spark, d):
    """AGG-14, RES-29/43: mean vector of every cluster."""
    return X.centroids(table(spark, d, "embeddings"), "label").withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


_NC = (
    f"WITH c AS ({_CENT}), s AS (SELECT e.vec_id, e.label, c.label AS k, round(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 6) AS s FROM embeddings e, c), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS rn, round(s - lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, k), 6) AS margin FROM s), nc AS (SELECT vec_id, label, k AS nearest, s AS similarity, margin, margin < 0.045 AS review FROM r WHERE rn = 1)"
)


@query(_NC + " SELECT * FROM nc")
def nearest_centroid(spark, d):
    """WIN-07, CLU-12: nearest cluster, margin to the second, review flag."""
    e = table(spark, d, "embeddings")
    return X.nearest_centroid(e, X.centroids(e, "label"), "label")


@query(_NC + " SELECT label, vec_id, similarity, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT e.label, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 6) AS similarity FROM embeddings e JOIN c USING (label)) QUALIFY rank <= 3")
def representatives(spark, d):
    """TOP-07: the three vectors nearest to the centroid of every cluster."""
    e = table(spark, d, "embeddings")
    j = e.join(X.centroids(e, "label"), "label").withColumn("similarity", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 6))
    w = Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("label", "vec_id", "similarity", "rank")


@query(f"WITH c AS ({_CENT}) SELECT c.label, c.size, (SELECT round(avg(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid)), 6) FROM embeddings e WHERE e.label = c.label) AS cohesion, (SELECT round(max(list_cosine_similarity(b.centroid, c.centroid)), 6) FROM c b WHERE b.label <> c.label) AS nearest_other, (SELECT round(min(list_cosine_similarity(b.centroid, c.centroid)), 6) FROM c b WHERE b.label <> c.label) AS farthest_other FROM c")
def centroid_metrics(spark, d):
    """AGG-15: cohesion of every cluster and similarity to other centroids."""
    e = table(spark, d, "embeddings")
    return X.cohesion(e, X.centroids(e, "label"), "label")


@query(f"WITH c AS ({_CENT}), g AS (SELECT list(m ORDER BY dim) AS mean FROM (SELECT i AS dim, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY i)), w AS (SELECT sum(list_distance(e.embedding::DOUBLE[], c.centroid) ** 2) AS w FROM embeddings e JOIN c USING (label)), b AS (SELECT sum(size * list_distance(centroid, mean) ** 2) AS b, count(*) AS k, sum(size)::BIGINT AS n, min(size) AS lo, max(size) AS hi, avg(CASE WHEN size = 1 THEN 1 ELSE 0 END) AS single FROM c, g) SELECT k, n, round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz, round(lo / hi::DOUBLE, 6) AS balance, round(single, 6) AS singletons FROM b, w")
def cluster_dispersion(spark, d):
    """AGG-16: dispersion, balance, singletons of a clustering."""
    e = table(spark, d, "embeddings")
    return X.dispersion(e, X.centroids(e, "label"), "label")


@query(_NC + ", " + E.CONTINGENCY_SQL.format(rows="SELECT label AS gold, nearest AS pred FROM nc") + E.CLUSTERING_SQL)
def clustering_eval(spark, d):
    """AGG-21, EVL-03: purity, ARI, NMI, homogeneity, completeness, V-measure from the contingency table."""
    e = table(spark, d, "embeddings")
    return E.clustering_scores(X.nearest_centroid(e, X.centroids(e, "label"), "label").select(F.col("label").alias("gold"), F.col("nearest").alias("pred")))


@query(_NC + " SELECT label AS gold, nearest AS pred, count(*) AS n FROM nc WHERE label <> nearest GROUP BY ALL")
def confusion_pairs(spark, d):
    """AGG-28: confused pairs with counts."""
    e = table(spark, d, "embeddings")
    return E.confusions(X.nearest_centroid(e, X.centroids(e, "label"), "label").select(F.col("label").alias("gold"), F.col("nearest").alias("pred")))


@query(_NC + ", " + E.PRF_SQL.format(rows="SELECT label AS gold, nearest AS pred FROM nc"))
def label_prf(spark, d):
    """AGG-18: precision, recall and F1 of every label."""
    e = table(spark, d, "embeddings")
    return E.label_prf(X.nearest_centroid(e, X.centroids(e, "label"), "label").select(F.col("label").alias("gold"), F.col("nearest").alias("pred")))


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS turn FROM embeddings ORDER BY turn, label LIMIT 40")
def stratified_limit(spark, d):
    """WIN-10, EVL-01: round-robin over the labels up to a limit."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").select("vec_id", "label", F.row_number().over(w).alias("turn")).orderBy("turn", "label").limit(40)


@query("SELECT vec_id, round(CASE WHEN max(v) OVER () > min(v) OVER () THEN 5 + 90 * (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) ELSE 50 END, 6) AS x FROM (SELECT vec_id, embedding[1]::DOUBLE AS v FROM embeddings)")
def minmax_scaling(spark, d):
    """WIN-08: scaling to 5..95; ends come from an aggregate, not from one window over all rows."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("v"))
    ends = e.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    x = F.when(F.col("hi") > F.col("lo"), 5 + 90 * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(50.0)
    return e.join(F.broadcast(ends)).select("vec_id", F.round(x, 6).alias("x"))


@query(f"WITH c AS ({_CENT}), s AS (SELECT e.vec_id, c.label AS k, list_cosine_similarity(e.embedding::DOUBLE[], c.centroid) AS s FROM embeddings e, c), x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS z FROM s) SELECT vec_id, k AS label, round(z / sum(z) OVER (PARTITION BY vec_id), 6) AS p FROM x")
def softmax_scores(spark, d):
    """MATH-04: softmax of the similarities to all clusters, shifted by the maximum."""
    e = table(spark, d, "embeddings")
    j = X.with_centroids(e, X.centroids(e, "label"), "label").select("vec_id", F.transform("all", lambda c: F.struct(c["c"].alias("label"), V.cosine(F.col("embedding"), c["v"]).alias("s"))).alias("a"))
    top = F.array_max(F.transform("a", lambda x: x["s"]))
    z = j.withColumn("z", F.transform("a", lambda x: F.exp(x["s"] - top)))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x)
    return z.select("vec_id", F.inline(F.zip_with("a", "z", lambda a, x: F.struct(a["label"].alias("label"), F.round(x / total, 6).alias("p")))))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length, round(1 / (1 + exp(-6 * embedding[1]::DOUBLE)), 6) AS calibrated, round(1 / log2(label + 2), 6) AS discount FROM embeddings")
def vector_scalars(spark, d):
    """MATH-02, MATH-05, MATH-07: length, sigmoid calibration, rank discount."""
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("length"), F.round(V.margin_confidence(F.col("embedding")[0].cast("double")), 6).alias("calibrated"), F.round(V.rank_discount(F.col("label")), 6).alias("discount"))


@query()
def kmeans_clusters(spark, d):
    """CLU-01: k-means clusters (rows only: seeds differ between engines)."""
    return X.kmeans(table(spark, d, "embeddings"), 10)


@query()
def bucketed_clusters(spark, d):
    """CLU-13: micro-clusters merged by their centroids (rows only)."""
    return X.bucketed_clusters(table(spark, d, "embeddings"), 20)


@query()
def agglomerative_groups(spark, d):
    """CLU-02: average-link clusters within every label and id bucket (rows only)."""
    e = table(spark, d, "embeddings").withColumn("g", (F.col("label") * 1000 + F.floor(F.col("vec_id") / 500)).cast("int"))
    return X.agglomerate(e, "g", 0.3)


@query()
def pca_projection(spark, d):
    """CLU-08: two principal components (rows only: signs are free)."""
    return X.project(table(spark, d, "embeddings"))
