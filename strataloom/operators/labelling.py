"""Cluster labels and cluster quality: phrase-weighted centres, label candidates and their scores, terms.

Sums over a cluster stand for sums over its pairs wherever that is exact (cosines of unit vectors are
linear), so nothing here forms the pairs of a cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import vectors as V
from strataloom.session import checkpoint_dir


def source_score(weight: Column, frequency: Column, rank: Column) -> Column:
    """Standing of a phrase in its cluster: weight times log(1 + frequency), discounted by rank (from 0)."""
    return weight * F.log1p(frequency) / F.log2(rank + 2)


def vector_sums(rows: DataFrame, key: str, vec: str, weight: str) -> DataFrame:
    """Weighted sum of unit vectors by key: (key, n, total weight, sum)."""
    parts = rows.select(key, F.col(weight).alias("w"), F.posexplode(V.unit(F.col(vec))).alias("dim", "x"))
    dims = parts.groupBy(key, "dim").agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.count("*").alias("n"), F.sum("w").alias("total"))
    return dims.groupBy(key).agg(F.max("n").alias("n"), F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("sum"))


def phrase_centres(phrases: DataFrame) -> DataFrame:
    """RES-29: centre of every cluster from its phrases' vectors, weighted by their standing: the
    weighted mean (``mean``) and the same at length 1 (``centre``). ``phrases``: (cluster_id, text,
    weight, frequency, rank, vector)."""
    s = vector_sums(phrases.withColumn("w", source_score(F.col("weight"), F.col("frequency"), F.col("rank"))), "cluster_id", "vector", "w")
    s = s.withColumn("mean", F.transform("sum", lambda x: x / F.greatest(F.col("total"), F.lit(1e-12))))
    return s.select("cluster_id", "mean", V.unit(F.col("mean")).alias("centre"))


def evidence_centres(sentences: DataFrame, phrases: DataFrame) -> DataFrame:
    """RES-43: centre of a cluster from one sentence of each of its documents, all alike, not brought
    to length 1; the phrase-weighted centre where it has none. ``sentences``: (cluster_id, doc_id, place,
    vector); one without a vector does not stand for its document."""
    one = sentences.where(F.col("vector").isNotNull()).groupBy("cluster_id", "doc_id").agg(F.min_by("vector", "place").alias("vector")).withColumn("w", F.lit(1.0))
    s = vector_sums(one, "cluster_id", "vector", "w").select("cluster_id", F.transform("sum", lambda x: x / F.col("n")).alias("of_documents"))
    return phrase_centres(phrases).join(s, "cluster_id", "full_outer").select("cluster_id", F.coalesce("of_documents", "centre").alias("centre"), F.col("of_documents").isNotNull().alias("from_documents"))


def local_candidates(phrases: DataFrame, near: float = 0.35, far: float = 0.88, top: int = 8, paired: int = 6) -> DataFrame:
    """RES-30: the best phrases of every cluster, and pairs among the first of them whose vectors are
    neither too far apart nor too alike. At most top + paired * (paired - 1) / 2 rows a cluster."""
    p = phrases.withColumn("source", source_score(F.col("weight"), F.col("frequency"), F.col("rank")))
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("source", 9)), F.lower("text"), "text")
    p = p.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    single = p.select("cluster_id", F.col("text").alias("label"), F.lit("phrase").alias("origin"), "source", F.lit(1).alias("evidence"), F.lit(0.0).alias("diversity"), V.unit(F.col("vector")).alias("vector"))
    a, b = (p.where(F.col("place") <= paired).select("cluster_id", *(F.col(c).alias(f"{c}_{x}") for c in ("text", "source", "place", "vector"))) for x in "ab")
    pairs = a.join(b, "cluster_id").where("place_a < place_b").withColumn("alike", V.cosine(F.col("vector_a"), F.col("vector_b"))).where(F.col("alike").between(near, far))
    both = F.zip_with(V.unit(F.col("vector_a")), V.unit(F.col("vector_b")), lambda x, y: x + y)
    diversity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.88 - F.col("alike")) / 0.53))
    pair = pairs.select("cluster_id", F.concat_ws(" and ", "text_a", "text_b").alias("label"), F.lit("pair").alias("origin"), ((F.col("source_a") + F.col("source_b")) / 2).alias("source"), F.lit(2).alias("evidence"), diversity.alias("diversity"), V.unit(both).alias("vector"))
    return single.unionByName(pair)


def label_score(relevance: Column, coverage: Column, source: Column, distinct: Column, concise: Column, diversity: Column) -> Column:
    """RES-31, LAB-03: weighted score of a label candidate."""
    return F.round(0.38 * relevance + 0.24 * coverage + 0.16 * source + 0.10 * distinct + 0.08 * concise + 0.04 * diversity, 6)


def scored_candidates(candidates: DataFrame, centres: DataFrame, longest: int = 8) -> DataFrame:
    """RES-31, LAB-03: candidates with their score and the reasons that reject them.

    Relevance and coverage come from the cluster's centre and weighted mean, distinctiveness from the
    lead over the nearest other centre; a label of two words up to the limit is concise. Every candidate
    meets every centre, so centres are packed into one row: their number is that of the clusters of a task.
    """
    packed = centres.agg(F.collect_list(F.struct("cluster_id", "mean", "centre")).alias("all"))
    j = candidates.join(F.broadcast(packed))  # one row, of the centres only
    own = lambda f: F.element_at(F.filter("all", lambda c: c["cluster_id"] == F.col("cluster_id")), 1)[f]
    j = j.withColumns({"to_centre": V.dot(F.col("vector"), own("centre")), "to_mean": V.dot(F.col("vector"), own("mean"))})
    others = F.array_max(F.transform(F.filter("all", lambda c: c["cluster_id"] != F.col("cluster_id")), lambda c: V.dot(F.col("vector"), c["centre"])))
    j = j.withColumns({"lead": F.col("to_centre") - F.coalesce(others, F.lit(-1.0)), "best_source": F.max("source").over(Window.partitionBy("cluster_id")), "length": F.size(F.split("label", " "))})
    concise = F.least(F.lit(1.0), F.col("length") / 2.0, longest / F.col("length"))
    score = label_score((F.col("to_centre") + 1) / 2, (F.col("to_mean") + 1) / 2, F.col("source") / F.col("best_source"), V.margin_confidence(F.col("lead")), concise, F.col("diversity"))
    reasons = F.filter(F.array(F.when(F.char_length("label") < 2, "too short"), F.when(F.col("length") > longest, "too long"), F.when(F.col("evidence") < 1, "no evidence")), lambda x: x.isNotNull())
    return j.select("cluster_id", "label", "origin", score.alias("score"), reasons.alias("rejected"))


def cluster_quality(rows: DataFrame, cluster: str, vec: str) -> DataFrame:
    """AGG-15, AGG-16: for every cluster its size, mean cosine over all its pairs (null for one vector),
    separation (mean similarity to its centre less the least similarity of its centre to another's) and
    mean cosine silhouette. All from one sum a cluster: exact, without forming pairs."""
    ones = rows.withColumn("w", F.lit(1.0))
    sums = vector_sums(ones, cluster, vec, "w").select(F.col(cluster).alias("c"), F.col("n").alias("m"), "sum")
    packed = sums.agg(F.collect_list(F.struct("c", "m", "sum")).alias("all"))
    r = rows.select(cluster, V.unit(F.col(vec)).alias("u")).join(F.broadcast(packed))  # one row, of the clusters' sums
    to = F.transform("all", lambda s: F.struct((s["c"] == F.col(cluster)).alias("own"), s["m"].alias("m"), V.dot(F.col("u"), s["sum"]).alias("d")))
    r = r.withColumn("to", to).withColumn("own", F.element_at(F.filter("to", lambda x: x["own"]), 1))
    a = F.when(F.col("own.m") > 1, 1 - (F.col("own.d") - 1) / (F.col("own.m") - 1))
    b = F.array_min(F.transform(F.filter("to", lambda x: ~x["own"]), lambda x: 1 - x["d"] / x["m"]))
    silhouette = F.when(a.isNull() | b.isNull(), 0.0).otherwise((b - a) / F.greatest(a, b))
    each = r.groupBy(cluster).agg(F.count("*").alias("size"), F.avg(silhouette).alias("silhouette"), F.avg(F.col("own.d") / F.col("own.m")).alias("to_centre"), F.sum(F.col("own.d") - 1).alias("pairs"), F.first("all").alias("all"))
    centre = lambda s: F.transform(s["sum"], lambda x: x / s["m"])
    mine = F.element_at(F.filter("all", lambda s: s["c"] == F.col(cluster)), 1)
    other = F.array_min(F.transform(F.filter("all", lambda s: s["c"] != F.col(cluster)), lambda s: V.dot(centre(mine), centre(s))))
    n = F.col("size")
    return each.select(cluster, "size", F.round(F.when(n > 1, F.col("pairs") / (n * (n - 1))), 5).alias("pairwise"), F.round(F.col("to_centre") - F.coalesce(other, F.lit(0.0)), 5).alias("separation"), F.round("silhouette", 5).alias("silhouette"))


def davies_bouldin(rows: DataFrame, cluster: str, cents: DataFrame, vec: str) -> DataFrame:
    """AGG-16: Davies-Bouldin index: mean over clusters of the worst sum of two mean distances to the centre
    relative to the centres' distance. ``cents``: (cluster, centroid), packed into one row."""
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    spread = rows.join(cents.select(cluster, "centroid"), cluster).groupBy(cluster).agg(F.avg(far(F.col(vec), F.col("centroid"))).alias("s"), F.first("centroid").alias("c"))
    packed = spread.agg(F.collect_list(F.struct(F.col(cluster).alias("k"), "s", "c")).alias("all"))
    j = spread.join(F.broadcast(packed))  # one row
    worst = F.array_max(F.transform(F.filter("all", lambda o: o["k"] != F.col(cluster)), lambda o: (F.col("s") + o["s"]) / far(F.col("c"), o["c"])))
    return j.agg(F.count("*").alias("clusters"), F.round(F.avg(worst), 5).alias("davies_bouldin"))


def cluster_label_terms(rows: DataFrame) -> DataFrame:
    """AGG-13: the best term of every cluster by count times IDF, halved for a term within another of the
    cluster's; ties by documents, then length. ``rows``: (cluster_id, doc_id, term, n).

    Containment is an equi-join with the parts of longer terms, so unrelated terms never meet.
    """
    docs = rows.agg(F.countDistinct("doc_id").alias("docs"))
    df = rows.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    counts = rows.groupBy("cluster_id", "term").agg(F.sum("n").alias("n"), F.countDistinct("doc_id").alias("hits"))
    size = F.char_length("term")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda k: F.substring("term", i, k))))
    inner = counts.select("cluster_id", F.col("term").alias("longer"), F.explode(F.array_distinct(parts)).alias("term")).where("term <> longer").select("cluster_id", "term").distinct().withColumn("inner", F.lit(0.5))
    j = counts.join(df, "term").join(inner, ["cluster_id", "term"], "left").join(F.broadcast(docs))  # one row
    score = F.col("n") * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1) * F.coalesce("inner", F.lit(1.0))
    j = j.withColumn("score", F.round(score, 6))
    return j.groupBy("cluster_id").agg(F.max_by("term", F.struct("score", "hits", F.char_length("term"), "term")).alias("label"), F.max("score").alias("score"))


def representative_terms(rows: DataFrame, limit: int = 6) -> DataFrame:
    """AGG-12: up to ``limit`` terms of every cluster by documents times IDF plus 2.5 for each document
    that has the term as a keyword, none within another. ``rows``: distinct (cluster_id, doc_id, term, keyword).

    One term is chosen for all clusters at a time; those it contains or is contained in leave.
    """
    checkpoint_dir(rows.sparkSession)
    docs = rows.agg(F.countDistinct("doc_id").alias("docs"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    c = rows.where(F.char_length("term").between(2, 24)).groupBy("cluster_id", "term").agg(F.count("*").alias("freq"), F.count_if("keyword").alias("kw"))
    score = F.round(F.col("freq") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1) + 2.5 * F.col("kw"), 6)
    left = c.join(df, "term").join(F.broadcast(docs)).select("cluster_id", "term", "kw", score.alias("score")).checkpoint()  # docs is one row
    out = None
    for place in range(1, limit + 1):
        best = left.groupBy("cluster_id").agg(F.max_by(F.struct("term", "score"), F.struct("score", "kw", F.char_length("term"), "term")).alias("b")).select("cluster_id", F.col("b.term").alias("chosen"), F.col("b.score").alias("chosen_score")).checkpoint()
        rows_out = best.select("cluster_id", F.lit(place).alias("place"), F.col("chosen").alias("term"), F.col("chosen_score").alias("score"))
        out = rows_out if out is None else out.unionByName(rows_out)
        left = left.join(best, "cluster_id").where(~F.contains("term", F.col("chosen")) & ~F.contains("chosen", F.col("term"))).select("cluster_id", "term", "kw", "score")
    return out
