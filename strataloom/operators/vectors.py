"""Vector search, neighbours, centroids, cluster metrics and clustering.

Search takes a stated set of query rows against all rows, in blocks of at most ``BLOCK`` queries:
each block goes to the workers as a matrix, every batch of rows is scored by one matrix product and
keeps its best k for each query, and a grouped step merges the batches' lists. Nothing but these
partial lists is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import vectors as V

#: Queries sent to the workers at once.
BLOCK = 2000


def _matrix(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _scorer(ids: list[int], queries: np.ndarray, k: int, id_col: str, vec_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b[vec_col].notna()]
            if b.empty:
                continue
            own = b[id_col].to_numpy()
            s = np.round(queries @ _matrix(b[vec_col].tolist()).T, 6)
            out = []
            for q, row in zip(ids, s):
                order = np.lexsort((own, -row))
                order = order[own[order] != q][:k]
                out.append(pd.DataFrame({"query_id": q, "neighbour": own[order], "similarity": row[order]}))
            yield pd.concat(out)

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows (cosine; ties by id) of every query row, itself excluded, with their rank."""
    out = None
    block: list = []

    def search() -> DataFrame:
        ids = [r[0] for r in block]
        return rows.select(id_col, vec_col).mapInPandas(_scorer(ids, _matrix([r[1] for r in block]), k, id_col, vec_col), "query_id long, neighbour long, similarity double")

    for r in queries.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).toLocalIterator():
        block.append((r[0], list(r[1])))
        if len(block) == BLOCK:
            out = search() if out is None else out.unionByName(search())
            block = []
    if block:
        out = search() if out is None else out.unionByName(search())
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, neighbour long, similarity double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mutual_pairs(queries: DataFrame, rows: DataFrame, k: int = 5, sure: float = 0.62, floor: float = 0.55, id_col: str = "vec_id") -> DataFrame:
    """JOIN-18: pairs of a query and a neighbour that are alike enough, or each other's near neighbours above a floor."""
    near = top_k(queries, rows, k, id_col)
    back = top_k(rows.join(near.select(F.col("neighbour").alias(id_col)).distinct(), id_col), rows, k, id_col)
    b = back.select(F.col("query_id").alias("neighbour"), F.col("neighbour").alias("query_id"), F.lit(True).alias("mutual"))
    j = near.join(b, ["query_id", "neighbour"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False)))
    return j.where((F.col("similarity") >= sure) | (F.col("mutual") & (F.col("similarity") >= floor))).select("query_id", "neighbour", "similarity", "mutual")


def centroids(rows: DataFrame, cluster: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector of every cluster: averaged by dimension, combined before the shuffle."""
    d = rows.select(cluster, F.posexplode(vec_col).alias("dim", "x")).groupBy(cluster, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return d.groupBy(cluster).agg(F.max("n").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("centroid"))


def with_centroids(rows: DataFrame, cents: DataFrame, cluster: str) -> DataFrame:
    """Every row beside the centroids of all clusters, as one array; clusters are few and counted."""
    packed = cents.agg(F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("centroid").alias("v")))).alias("all"))
    return rows.join(F.broadcast(packed))  # one row


def nearest_centroid(rows: DataFrame, cents: DataFrame, cluster: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Nearest cluster of every row by cosine, with the margin to the second and whether to review it."""
    s = F.transform("all", lambda c: F.struct(F.round(V.cosine(F.col(vec_col), c["v"]), 6).alias("s"), (-c["c"]).alias("o"), c["c"].alias("c")))
    best = F.sort_array(s, asc=False)
    j = with_centroids(rows, cents, cluster).withColumn("best", best)
    margin = F.round(F.col("best")[0]["s"] - F.coalesce(F.get("best", F.lit(1))["s"], F.lit(0.0)), 6)
    return j.select(id_col, cluster, F.col("best")[0]["c"].alias("nearest"), F.col("best")[0]["s"].alias("similarity"), margin.alias("margin"), (margin < 0.045).alias("review"))


def ranked_centroids(rows: DataFrame, cents: DataFrame, cluster: str, k: int, vec_col: str = "embedding") -> DataFrame:
    """The rows with their ``k`` nearest clusters: array<struct<code, score>>, best first, ties by code."""
    scored = F.transform("all", lambda c: F.struct((-F.round(V.cosine(F.col(vec_col), c["v"]), 6)).alias("s"), c["c"].alias("code")))
    best = F.slice(F.array_sort(scored), 1, k)
    return with_centroids(rows, cents, cluster).withColumn("candidates", F.transform(best, lambda x: F.struct(x["code"].alias("code"), (-x["s"]).alias("score")))).drop("all")


def cohesion(rows: DataFrame, cents: DataFrame, cluster: str, vec_col: str = "embedding") -> DataFrame:
    """AGG-15: mean similarity to the own centroid, and to the nearest and farthest other centroid."""
    own = rows.join(cents.select(cluster, F.col("centroid").alias("own")), cluster).groupBy(cluster).agg(F.count("*").alias("size"), F.round(F.avg(V.cosine(F.col(vec_col), F.col("own"))), 6).alias("cohesion"))
    other = F.filter("all", lambda c: c["c"] != F.col(cluster))
    sims = F.transform(other, lambda c: V.cosine(F.col("centroid"), c["v"]))
    sep = with_centroids(cents, cents, cluster).select(cluster, F.round(F.array_max(sims), 6).alias("nearest_other"), F.round(F.array_min(sims), 6).alias("farthest_other"))
    return own.join(sep, cluster)


def dispersion(rows: DataFrame, cents: DataFrame, cluster: str, vec_col: str = "embedding") -> DataFrame:
    """AGG-16: Calinski-Harabasz index, balance and share of singletons, by aggregates."""
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    mean = centroids(rows.withColumn("one", F.lit(1)), "one", vec_col).select(F.col("centroid").alias("mean"))
    within = rows.join(cents.select(cluster, "centroid"), cluster).agg(F.sum(sq(F.col(vec_col), F.col("centroid"))).alias("w"))
    between = cents.join(F.broadcast(mean)).agg(F.sum(F.col("size") * sq(F.col("centroid"), F.col("mean"))).alias("b"), F.count("*").alias("k"), F.sum("size").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.avg((F.col("size") == 1).cast("int")).alias("single"))
    j = between.join(F.broadcast(within))  # both are one row
    return j.select("k", "n", F.round((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))), 4).alias("calinski_harabasz"), F.round(F.col("lo") / F.col("hi"), 6).alias("balance"), F.round("single", 6).alias("singletons"))


def kmeans(rows: DataFrame, k: int, seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """CLU-01: k-means with a fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = rows.select(id_col, array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed, initSteps=4).fit(v).transform(v).select(id_col, F.col("prediction").alias("cluster"))


def project(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """CLU-08, WIN-08: two principal components scaled to 5..95; a constant one gives 50."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.select(id_col, array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("features"))
    p = PCA(k=2, inputCol="features", outputCol="p").fit(v).transform(v).select(id_col, vector_to_array("p").alias("p"))
    ends = p.agg(*(f(F.col("p")[i]).alias(f"{n}{i}") for i in (0, 1) for f, n in ((F.min, "lo"), (F.max, "hi"))))
    scaled = lambda i: F.when(F.col(f"hi{i}") > F.col(f"lo{i}"), 5 + 90 * (F.col("p")[i] - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}"))).otherwise(50.0)
    return p.join(F.broadcast(ends)).select(id_col, F.round(scaled(0), 3).alias("x"), F.round(scaled(1), 3).alias("y"))  # one row


def _average_link(m: np.ndarray, threshold: float) -> list[int]:
    """Agglomerative clustering by average cosine similarity down to a threshold."""
    sim = m @ m.T
    groups = [[i] for i in range(len(m))]
    total = sim.copy()
    while len(groups) > 1:
        sizes = np.array([len(g) for g in groups])
        mean = total / np.outer(sizes, sizes)
        np.fill_diagonal(mean, -2)
        at = int(mean.argmax())
        a, b = sorted(divmod(at, len(groups)))
        if mean[a, b] < threshold:
            break
        total[a] += total[b]
        total[:, a] += total[:, b]
        total = np.delete(np.delete(total, b, 0), b, 1)
        groups[a] += groups.pop(b)
    label = [0] * len(m)
    for c, g in enumerate(sorted(groups, key=min)):
        for i in g:
            label[i] = c
    return label


def agglomerate(rows: DataFrame, group: str, threshold: float, most: int = 2000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """CLU-02: average-link clusters within every group. A group is one task's items; one with more
    than ``most`` rows is refused (RuntimeError) rather than collected into one task."""
    big = rows.groupBy(group).count().where(F.col("count") > most)
    if not big.isEmpty():
        raise RuntimeError(f"a group has more than {most} rows; bucket it first (see bucketed_clusters)")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        return pd.DataFrame({group: pdf[group], id_col: pdf[id_col], "cluster": _average_link(_matrix(pdf[vec_col].tolist()), threshold)})

    kind = dict(rows.dtypes)
    return rows.select(group, id_col, vec_col).groupBy(group).applyInPandas(run, f"{group} {kind[group]}, {id_col} {kind[id_col]}, cluster int")


def bucketed_clusters(rows: DataFrame, buckets: int, threshold: float = 0.78, seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """CLU-13: k-means micro-clusters whose centroids are merged by average link."""
    micro = rows.join(kmeans(rows, buckets, seed, id_col, vec_col), id_col)
    cents = centroids(micro, "cluster", vec_col).withColumn("g", F.lit(0))
    merged = agglomerate(cents.select("g", F.col("cluster").alias("micro"), "centroid"), "g", threshold, id_col="micro", vec_col="centroid")
    return micro.join(merged.select(F.col("micro").alias("cluster"), F.col("cluster").alias("merged")), "cluster").select(id_col, F.col("cluster").alias("micro"), F.col("merged").alias("cluster"))


def propagate_labels(edges: DataFrame, most: int = 100) -> DataFrame:
    """SET-18: communities of a weighted graph (src, dst, weight; both directions) by label propagation.

    Every round a node takes the label with the largest summed weight among its neighbours and itself
    (which counts as its strongest edge, so that two nodes cannot swap labels for ever), ties to the
    least label, until no label changes. The lineage is cut each round; no result after ``most`` rounds
    is an error.
    """
    from strataloom.session import checkpoint_dir

    checkpoint_dir(edges.sparkSession)
    labels = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("label", F.col("node")).checkpoint()
    own = edges.groupBy(F.col("dst").alias("src")).agg(F.max("weight").alias("weight")).select("src", F.col("src").alias("dst"), "weight")
    links = edges.select("src", "dst", "weight").unionByName(own).checkpoint()
    for _ in range(most):
        votes = links.join(labels.withColumnRenamed("node", "src"), "src").groupBy("dst", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("dst").agg(F.max_by("label", F.struct(F.round("w", 9), -F.col("label"))).alias("new"))
        new = labels.join(best, F.col("node") == F.col("dst"), "left").select("node", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("changed")).checkpoint()
        labels = new.drop("changed")
        if new.where("changed").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {most} rounds")
