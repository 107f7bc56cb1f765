"""Trends, hotspots, distributions and other reports over clusters and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def yearly_grid(rows: DataFrame) -> DataFrame:
    """AGG-05: counts of (cluster, year) on the full grid, 0 where there is nothing.

    The grid is made from the distinct clusters and the range of years, not from the rows.
    """
    counts = rows.groupBy("cluster", "year").agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    grid = counts.select("cluster").distinct().join(F.broadcast(ends)).select("cluster", F.explode(F.sequence("lo", "hi")).alias("year"))  # one row
    return grid.join(counts, ["cluster", "year"], "left").select("cluster", "year", F.coalesce("n", F.lit(0)).alias("n"))


def trend_classes(rows: DataFrame) -> DataFrame:
    """AGG-06: emerging, rising or stable, from the last three years, the three before, the first year
    and the share of years with output; null where none applies."""
    last = rows.agg(F.max("year").alias("y"))
    c = rows.groupBy("cluster", "year").agg(F.count("*").alias("n")).join(F.broadcast(last))  # one row
    between = lambda a, b: F.sum(F.when((F.col("year") >= F.col("y") - a) & (F.col("year") <= F.col("y") - b), F.col("n")).otherwise(0))
    g = c.groupBy("cluster", "y").agg(F.min("year").alias("first"), F.sum("n").alias("total"), F.count("*").alias("years"), between(2, 0).alias("recent"), between(5, 3).alias("previous"))
    span = F.col("y") - F.col("first") + 1
    ratio = F.try_divide("recent", "previous")
    stable = (span >= 5) & (F.col("years") / span >= 0.5) & (F.col("previous") >= 1) & ratio.between(0.5, 2)
    trend = F.when(F.col("first") >= F.col("y") - 2, "emerging").when(F.col("recent") >= F.greatest(F.lit(2), 2 * F.col("previous")), "rising").when(stable, "stable")
    return g.select("cluster", "first", "total", "recent", "previous", trend.alias("trend"))


def representatives(trends: DataFrame) -> DataFrame:
    """AGG-07: the largest cluster of every trend; ties to the greater name."""
    return trends.where("trend IS NOT NULL").groupBy("trend").agg(F.max_by("cluster", F.struct("total", "cluster")).alias("cluster"))


def half_trends(rows: DataFrame) -> DataFrame:
    """AGG-08: growth from the earlier to the later half of the years."""
    ends = rows.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    j = rows.join(F.broadcast(ends)).withColumn("late", (F.col("year") > (F.col("lo") + F.col("hi")) / 2).cast("long"))  # one row
    g = j.groupBy("cluster").agg(F.sum(1 - F.col("late")).alias("early"), F.sum("late").alias("late"))
    return g.withColumn("trend", F.when(F.col("late") > F.col("early") * 1.2, "up").when(F.col("late") < F.col("early") * 0.8, "down").otherwise("flat"))


def hotspots(rows: DataFrame) -> DataFrame:
    """AGG-09: .4 freshness + .25 relevance + .2 persistence + .15 share, held in [.05, 1], with a label."""
    ends = rows.agg(F.max("year").alias("y"), F.count("*").alias("all"), F.countDistinct("year").alias("span"))
    j = rows.join(F.broadcast(ends))  # one row
    g = j.groupBy("cluster", "all", "span").agg(F.count("*").alias("n"), F.avg((F.col("year") >= F.col("y") - 2).cast("int")).alias("fresh"), F.countDistinct("year").alias("years"), F.avg("relevance").alias("relevance"))
    score = 0.4 * F.col("fresh") + 0.25 * F.col("relevance") + 0.2 * F.col("years") / F.col("span") + 0.15 * F.col("n") / F.col("all")
    s = F.round(F.least(F.greatest(score, F.lit(0.05)), F.lit(1.0)), 3)
    return g.select("cluster", "n", s.alias("score"), F.when(s >= 0.6, "hot").when(s >= 0.4, "warm").otherwise("cool").alias("status"))


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """AGG-17: counts, shares of all and mean value by group."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("v"))
    total = g.agg(F.sum("n").alias("t"))
    return g.join(F.broadcast(total)).select(*by, "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.round("v", 6).alias("mean"))  # one row


def by_split(rows: DataFrame, split: str, value: str) -> DataFrame:
    """AGG-20: means overall and by split in one pass."""
    g = rows.groupingSets([[F.col(split)], []], F.col(split)).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return g.select(F.coalesce(split, F.lit("all")).alias("split"), "n", "mean")


def ordinal_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """WIN-09: ids C01, C02, ... of clusters by first appearance; only one row a cluster is ordered."""
    first = rows.groupBy(key).agg(F.min(order).alias("first"))
    return first.select(key, F.format_string("C%02d", F.row_number().over(Window.orderBy("first", key))).alias("ordinal"))


def topk_per_type(rows: DataFrame, group: list[str], score: str, least: float = 0.40, near: float = 0.15) -> DataFrame:
    """WIN-06: the best row of every group, and the second where it is near the first; fitness floor."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), "id")
    r = rows.where(F.col(score) >= least).withColumns({"rank": F.row_number().over(w), "top": F.max(score).over(Window.partitionBy(*group))})
    return r.where((F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("top") - F.col(score) <= near))).drop("top")


def imputed(rows: DataFrame, value: str, default: float = 0.9) -> DataFrame:
    """RES-04: missing values take the rounded mean of all, or a default where all are missing."""
    mean = rows.agg(F.round(F.avg(value), 3).alias("m"))
    return rows.join(F.broadcast(mean)).withColumn(value, F.coalesce(value, "m", F.lit(default))).drop("m")  # one row


def merged_marks(rows: DataFrame) -> DataFrame:
    """RES-11: equal (sentence, label) rows merged: distinct marks in order, highest confidence."""
    g = rows.groupBy("sentence", "label").agg(F.sort_array(F.collect_set("mark")).alias("marks"), F.max("confidence").alias("confidence"), F.min("ord").alias("first"))
    return g


def jaccard(a: str, b: str):
    """SET-08: overlap of two sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
