"""Grouping whose order counts: complete linkage and greedy merging within a task or document, label choice.

The first two run one group at a time; a group is the items of one task or document and must be bounded by
the caller (see ``limit``): larger groups are refused with an error instead of being collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import checkpoint_dir


def checked(df: DataFrame, group: str, limit: int) -> DataFrame:
    """``df`` if no group has more than ``limit`` rows, else ValueError."""
    if not df.groupBy(group).count().where(F.col("count") > limit).isEmpty():
        raise ValueError(f"a group has more than {limit} rows")
    return df


def complete_linkage(names: list[str], same) -> list[int]:
    """SET-10: items in order; the groups of two items are united if all pairs across them are the same.
    Groups are numbered by their first item."""
    group = list(range(len(names)))
    members = {i: [i] for i in group}
    for j in range(len(names)):
        for i in range(j):
            a, b = sorted((group[i], group[j]))
            if a != b and same(names[i], names[j]) and all(same(names[x], names[y]) for x in members[a] for y in members[b]):
                for y in members[b]:
                    group[y] = a
                members[a] += members.pop(b)
    place = {g: n for n, g in enumerate(sorted(members))}
    return [place[g] for g in group]


def same_term(a: str, b: str) -> bool:
    """SET-13: equal but for case, hyphens and a plural s, or initials of the other."""
    flat = lambda s: s.lower().replace("-", "").replace(" ", "").rstrip("s")
    initials = lambda s: "".join(w[0] for w in s.split() if w).lower()
    return flat(a) == flat(b) or (" " in a and initials(a) == b.lower()) or (" " in b and initials(b) == a.lower())


def term_groups(df: DataFrame, group: str, order: str, term: str, limit: int = 5000) -> DataFrame:
    """Complete-linkage groups of the terms of every group, in order."""
    kind = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, term])
        return pd.DataFrame({group: pdf[group], term: pdf[term], "same": complete_linkage(pdf[term].tolist(), same_term)})

    return checked(df.select(group, order, term), group, limit).groupBy(group).applyInPandas(run, f"{group} {kind[group]}, {term} string, same int")


def greedy_merge(df: DataFrame, group: str, order: str, vec: str, least: float = 0.70, limit: int = 5000) -> DataFrame:
    """SET-12: each vector joins the first group whose centroid is near enough, in order."""
    kind = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        sums: list[np.ndarray] = []
        out = []
        for v in pdf[vec]:
            v = np.asarray(v, float)
            v = v / (np.linalg.norm(v) or 1)
            sims = [float(v @ s) / (np.linalg.norm(s) or 1) for s in sums]
            at = next((i for i, s in enumerate(sims) if s >= least), None)
            if at is None:
                sums.append(v.copy())
                at = len(sums) - 1
            else:
                sums[at] += v
            out.append(at)
        return pd.DataFrame({group: pdf[group], order: pdf[order], "merged": out})

    return checked(df.select(group, order, vec), group, limit).groupBy(group).applyInPandas(run, f"{group} {kind[group]}, {order} {kind[order]}, merged int")


def extractive_candidates(terms: DataFrame, limit: int = 12) -> DataFrame:
    """LAB-01: label candidates of every cluster: phrase score from frequency, IDF and rank, best ``limit``."""
    from pyspark.sql import Window

    df = terms.groupBy("term").agg(F.countDistinct("cluster_id").alias("df"))
    n = terms.agg(F.countDistinct("cluster_id").alias("k"))
    j = terms.join(df, "term").join(F.broadcast(n))  # one row
    score = F.log1p("freq") * (F.log((F.col("k") + 1) / (F.col("df") + 0.5)) + 1) * F.when(F.col("term").contains(" "), 1.0).otherwise(0.88)
    w = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "term")
    return j.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("cluster_id", "term", "freq", "score", "rank")


def choose_labels(candidates: DataFrame) -> DataFrame:
    """LAB-04: labels chosen by score over all clusters so that no two clusters share one: what going through
    all candidates from the best down gives (ties by cluster, then term), without that order.

    In every round the candidates that are the best of their cluster and the best of their term are
    taken, and their clusters and terms leave; no other choice could take them away. ``candidates``:
    (cluster_id, term, score), distinct. A cluster whose terms are all taken has no label.
    """
    checkpoint_dir(candidates.sparkSession)
    left = candidates.select("cluster_id", "term", "score").distinct().withColumn("o", F.struct((-F.col("score")).alias("s"), "cluster_id", "term")).checkpoint()
    out = None
    while not left.isEmpty():
        of_cluster = left.groupBy("cluster_id").agg(F.min("o").alias("o"))
        of_term = left.groupBy("term").agg(F.min("o").alias("o"))
        taken = of_cluster.select("o").join(of_term.select("o"), "o").select("o.cluster_id", "o.term").checkpoint()
        out = taken if out is None else out.unionByName(taken)
        left = left.join(taken.select("cluster_id"), "cluster_id", "left_anti").join(taken.select("term"), "term", "left_anti").checkpoint()
    none = candidates.select("cluster_id", F.col("term").alias("label")).limit(0)
    return none if out is None else out.withColumnRenamed("term", "label")
