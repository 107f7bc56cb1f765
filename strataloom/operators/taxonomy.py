"""Taxonomies: paths, resolution of codes, neighbours, kinds, cross-discipline tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import discipline
from strataloom.session import checkpoint_dir


def tree(regions: DataFrame, nations: DataFrame, suppliers: DataFrame) -> DataFrame:
    """A three-level taxonomy (code, parent, name) of the test tables."""
    r = regions.select(F.concat(F.lit("R"), "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    root = F.concat(F.lit("R"), "n_regionkey")
    mid = F.concat(root, F.lit("N"), "n_nationkey")
    n = nations.select(mid.alias("code"), root.alias("parent"), F.col("n_name").alias("name"))
    s = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(mid, F.lit("S"), "s_suppkey").alias("code"), mid.alias("parent"), F.col("s_name").alias("name"))
    return r.unionByName(n).unionByName(s)


def paths(t: DataFrame) -> DataFrame:
    """Path of every entry from its root, however deep; a cycle or a missing parent gives no path.

    Level by level until one is empty: each round joins the entries whose parent was reached in the round
    before, and cuts the lineage. An entry has one parent, so no entry is reached twice and a cycle never.
    """
    checkpoint_dir(t.sparkSession)
    level = t.where("parent IS NULL").select("code", F.array("code").alias("path"), F.col("name").alias("full_path")).checkpoint()
    out = level
    while not level.isEmpty():
        p = level.select(F.col("code").alias("parent"), "path", "full_path")
        level = t.where("parent IS NOT NULL").join(p, "parent").select("code", F.array_append("path", F.col("code")).alias("path"), F.concat_ws(" / ", "full_path", "name").alias("full_path")).checkpoint()
        out = out.unionByName(level)
    return out.withColumn("level", F.size("path"))


def resolve(asked: DataFrame, t: DataFrame, col: str) -> DataFrame:
    """Longest existing prefix of every code, null without one: prefixes are joined by equality."""
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.char_length(col)), lambda i: F.substring(F.col(col), F.lit(1), i)))
    found = asked.select(col, prefix.alias("code")).join(t.select("code"), "code", "left_semi").groupBy(col).agg(F.max_by("code", F.char_length("code")).alias("resolved"))
    return asked.join(found, col, "left")


def neighbours(t: DataFrame) -> DataFrame:
    """Numbers of children and siblings of every entry."""
    k = t.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("k"))
    children = k.select(F.col("parent").alias("code"), F.col("k").alias("children"))
    siblings = k.select("parent", (F.col("k") - 1).alias("siblings"))
    return t.join(children, "code", "left").join(siblings, "parent", "left").select("code", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("siblings", F.lit(0)).alias("siblings"))


def kind(t: DataFrame, least: float = 0.6) -> DataFrame:
    """'complete' where enough entries have their parent in the taxonomy, else 'scattered'."""
    p = t.select(F.col("code").alias("parent"), F.lit(1).alias("there")).distinct()
    j = t.join(p, "parent", "left")
    return j.agg(F.when(F.avg(F.coalesce("there", F.lit(0))) >= least, "complete").otherwise("scattered").alias("kind"), F.count("*").alias("entries"))


def crosses(a: Column, b: Column) -> Column:
    """Whether two codes belong to different disciplines."""
    return discipline(a) != discipline(b)


def same_branch(a: Column, b: Column) -> Column:
    return F.startswith(a, b) | F.startswith(b, a)
