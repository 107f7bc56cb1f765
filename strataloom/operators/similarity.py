"""Similarity joins of vectors over all rows, and the graphs made of them.

Equal vectors are one class from the start, so copies never join with each other. Candidates are those
that fall into one bucket of some table of random hyperplanes; a bucket that grows too large is cut by
further hyperplanes. Candidates whose signatures are too far apart are dropped, the rest scored exactly. The number of tables follows from the recall
that pairs at the threshold must reach.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions import vectors as V
from strataloom.operators import relational as R
from strataloom.session import checkpoint_dir

#: Hyperplanes of a bucket, recall at the threshold, rows from which a bucket is cut further, and bits of
#: the signature that is compared before the vectors are.
BITS, RECALL, MOST, SIGNS = 8, 0.95, 2000, 62


def tables_for(least: float, bits: int = BITS, recall: float = RECALL) -> int:
    """Tables after which a pair of cosine ``least`` has met with probability ``recall``."""
    meet = (1 - math.acos(least) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def classes(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Representatives (rep, vec) of equal vectors, and the class of every row: (id, rep)."""
    reps = rows.groupBy(F.col(vec_col).alias("vec")).agg(F.min(id_col).alias("rep"))
    return reps, rows.select(id_col, F.col(vec_col).alias("vec")).join(reps, "vec").select(id_col, "rep")


def similar_pairs(reps: DataFrame, least: float, bits: int = BITS, recall: float = RECALL, most: int = MOST, seed: int = 11) -> DataFrame:
    """Pairs (a, b, similarity) of representatives with a cosine of at least ``least``, a < b."""
    n = tables_for(least, bits, recall)

    apart = math.acos(least) / math.pi
    most_bits = math.ceil(SIGNS * apart + 4 * math.sqrt(SIGNS * apart * (1 - apart)))  # four deviations

    @F.pandas_udf("signs bigint, keys array<struct<near:bigint,far:bigint>>")
    def keys(vectors: pd.Series) -> pd.DataFrame:
        m = np.array(vectors.tolist(), np.float64)
        if not len(m):
            return pd.DataFrame({"signs": pd.Series([], dtype="int64"), "keys": pd.Series([], dtype=object)})
        planes = np.random.default_rng(seed).standard_normal((m.shape[1], n * 3 * bits + SIGNS))
        up = m @ planes > 0
        far = up[:, SIGNS:].reshape(len(m), n, 3 * bits) @ (1 << np.arange(3 * bits, dtype=np.int64))
        own = up[:, :SIGNS] @ (1 << np.arange(SIGNS, dtype=np.int64))
        return pd.DataFrame({"signs": own, "keys": [[(int(x) & ((1 << bits) - 1), int(x)) for x in row] for row in far]})

    checkpoint_dir(reps.sparkSession)
    keyed = reps.select("rep", "vec", keys("vec").alias("h")).checkpoint()  # read for the sizes of buckets and for both sides
    rows = keyed.select("rep", "vec", "h.signs", F.posexplode("h.keys").alias("t", "k")).select("rep", "vec", "signs", "t", "k.near", "k.far")
    big = rows.groupBy("t", "near").agg(F.count("*").alias("n")).where(F.col("n") > most).select("t", "near", F.lit(True).alias("big"))
    rows = rows.join(big, ["t", "near"], "left").select("rep", "vec", "signs", "t", F.when(F.col("big"), -F.col("far") - 1).otherwise(F.col("near")).alias("bucket"))
    a, b = (rows.select("t", "bucket", F.col("rep").alias(x), F.col("vec").alias(f"vec_{x}"), F.col("signs").alias(f"signs_{x}")) for x in "ab")
    near = F.bit_count(F.col("signs_a").bitwiseXOR(F.col("signs_b"))) <= most_bits
    scored = a.join(b, ["t", "bucket"]).where("a < b").where(near).dropDuplicates(["a", "b"]).withColumn("similarity", V.cosine(F.col("vec_a"), F.col("vec_b"))).where(F.col("similarity") >= least)
    return scored.select("a", "b", "similarity")


def method_groups(rows: DataFrame, least: float = 0.84, recall: float = RECALL) -> DataFrame:
    """SET-09, SET-11: (id, component) of methods that are linked by an equal normal form of their text or
    a cosine of at least ``least``. Equal forms are linked to their first row only. ``rows``: (id, text, vector)."""
    reps, member = classes(rows, "id", "vector")
    form = rows.select("id", T.key(F.col("text")).alias("form")).where("form <> ''")
    firsts = form.groupBy("form").agg(F.min("id").alias("first"))
    links = form.join(firsts, "form").select(F.col("id").alias("x"), F.col("first").alias("y"))
    links = links.unionByName(member.select(F.col("id").alias("x"), F.col("rep").alias("y"))).unionByName(similar_pairs(reps, least, recall=recall).select(F.col("a").alias("x"), F.col("b").alias("y")))
    found = R.components(links.where("x <> y").distinct(), "x", "y").withColumnRenamed("n", "id")
    return rows.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def shared_neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """CLU-05: graph of the k nearest neighbours, weighted .82 times the squared similarity plus .18 times
    the share of neighbours that both ends have. Only the ends of an edge are compared: linear in the edges.
    ``pairs``: (a, b, similarity), each once."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "similarity"))
    w = Window.partitionBy("x").orderBy(F.desc(F.round("similarity", 9)), "y")
    near = both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    lists = near.groupBy("x").agg(F.collect_set("y").alias("near"))  # at most k
    j = pairs.join(lists.select(F.col("x").alias("a"), F.col("near").alias("of_a")), "a").join(lists.select(F.col("x").alias("b"), F.col("near").alias("of_b")), "b")
    j = j.where(F.array_contains("of_a", F.col("b")) | F.array_contains("of_b", F.col("a")))
    weight = 0.82 * F.col("similarity") ** 2 + 0.18 * F.size(F.array_intersect("of_a", "of_b")) / k
    return j.select("a", "b", F.round(weight, 5).alias("weight"))
