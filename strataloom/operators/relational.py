"""Joins, rollups, latest states, lineage, deduplication, guarded updates and pages of stored records.

All of these are plain DataFrame operations; ties are broken by an id so that results are stable.
Null keys match nothing in joins; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import checkpoint_dir


def canonical_status(c: Column) -> Column:
    return F.upper(F.trim(c))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by ``order`` (the last column of which should be unique).

    An aggregate with ``max_by`` on a struct: partial results are combined before the shuffle, so a
    key that holds most rows costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def task_rollup(items: DataFrame) -> DataFrame:
    """Totals of every task's items (each item once, in its last state) and the resulting status."""
    last = latest_per_key(items, ["task_id", "input_index"], ["updated_at", "created_at", "id"])
    s = canonical_status(F.col("status"))
    g = last.withColumn("s", s).groupBy("task_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("s") == "SUCCEEDED").alias("success"), F.count_if(F.col("s") == "FAILED").alias("failed"),
        F.min_by("error_message", F.when(F.col("error_message").isNotNull(), F.col("input_index"))).alias("first_error"),
    )
    status = F.when(F.col("failed") == 0, "SUCCEEDED").when(F.col("success") == 0, "FAILED").otherwise("PARTIAL_FAILED")
    return g.withColumn("status", status)


def member_counts(parents: DataFrame, members: DataFrame, parent_id: str, member_key: str) -> DataFrame:
    """Every parent with the number of its distinct members, 0 where it has none."""
    counts = members.distinct().groupBy(F.col(member_key).alias(parent_id)).agg(F.count("*").alias("members"))
    return parents.join(counts, parent_id, "left").withColumn("members", F.coalesce("members", F.lit(0)))


def placed(rows: DataFrame, group: str, part: Column, order: list[Column | str]) -> DataFrame:
    """Place of every row (from 1) within its group, exact and without one task a group: rows are ranked
    within parts, and the sizes of the parts before are added. ``part`` must not decrease along ``order``."""
    r = rows.withColumn("_part", part)
    sizes = r.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sizes = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return r.withColumn("_own", own).join(sizes, [group, "_part"]).withColumn("place", F.col("_own") + F.col("_before")).drop("_own", "_part", "_before")


def ordered_members(members: DataFrame, docs: DataFrame, width: int = 1024) -> DataFrame:
    """JOIN-04: existing documents of every collection in their order; ties by document id. A collection is
    ranked in parts of ``width`` order numbers."""
    m = members.distinct().join(docs.select(F.col("id").alias("document_id"), "doc_id", "title"), "document_id")
    return placed(m, "collection_id", F.floor(F.col("order_no") / width), ["order_no", "document_id"]).select("collection_id", "document_id", "doc_id", "title", "place")


def content_key(title: Column, abstract: Column, content: Column) -> Column:
    """SHA-256 of title, abstract and content joined by newlines, nulls as empty."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat(e(title), F.lit("\n"), e(abstract), F.lit("\n"), e(content)), 256)


def dedupe_by_content(docs: DataFrame) -> DataFrame:
    """One row for each content: its first document and how many documents have it."""
    key = content_key(F.col("title"), F.col("abstract_text"), F.col("content_text"))
    return docs.select(key.alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("copies"))


def once_each(df: DataFrame, key: str, compute: dict[str, Column]) -> DataFrame:
    """SET-03: compute values once for every distinct input and give them to all its rows."""
    values = df.select(key).distinct().withColumns(compute)
    return df.join(values, key, "left")


def new_rows(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, the first of equal ones."""
    return incoming.join(stored.select(key).distinct(), key, "left_anti")


def lineage(edges: DataFrame, source: str, target: str) -> DataFrame:
    """One hop up and down: distinct (node, direction, neighbour)."""
    e = edges.select(source, target).distinct()
    down = e.select(F.col(source).alias("node"), F.lit("downstream").alias("direction"), F.col(target).alias("neighbour"))
    return down.unionByName(e.select(F.col(target).alias("node"), F.lit("upstream").alias("direction"), F.col(source).alias("neighbour")))


def by_id_or_number(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keep: list[str]) -> DataFrame:
    """Equi-join on the id; rows without a partner are joined on the trailing number of the ids."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("long")
    exact = left.join(right, F.col(left_id) == F.col(right_id)).select(*keep, F.lit("id").alias("matched_by"))
    rest = left.join(right, F.col(left_id) == F.col(right_id), "left_anti")
    by_number = rest.join(right, number(F.col(left_id)) == number(F.col(right_id))).select(*keep, F.lit("number").alias("matched_by"))
    return exact.unionByName(by_number)


def overridden(base: DataFrame, overlay: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JOIN-07: values of the overlay win where they are not null."""
    o = overlay.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns))
    j = base.join(o, key, "left")
    return j.select(key, *(F.coalesce(f"_o_{c}", c).alias(c) for c in columns))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK-10: rows of keys that ``new`` has are replaced by the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def guarded(df: DataFrame, to: str, allowed_from: list[str]) -> DataFrame:
    """SNK-09: the new status where the old one allows the change and the row is not archived."""
    ok = canonical_status(F.col("status")).isin(*allowed_from) & F.col("archived_at").isNull()
    return df.withColumn("new_status", F.when(ok, to).otherwise(canonical_status(F.col("status")))).withColumn("changed", ok)


def page(df: DataFrame, limit: int, order: list[Column], most: int = 200) -> DataFrame:
    """A page of a list; the limit is held between 1 and ``most``."""
    return df.orderBy(*order).limit(max(1, min(limit, most)))


def newest(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """TOP-06: the newest ``n`` rows of every group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def pairs_checked(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """JOIN-06: full outer join on the key that fails where either side lacks it."""
    j = gold.join(pred, key, "full_outer")
    missing = F.col("gold").isNull() | F.col("pred").isNull()
    return j.withColumn("gold", F.when(missing, F.raise_error(F.concat(F.lit("keys differ: "), F.col(key).cast("string")))).otherwise(F.col("gold")))


def components(edges: DataFrame, a: str, b: str, most: int = 50) -> DataFrame:
    """Connected components by propagating the least label; the lineage is cut by checkpoints.

    Each round takes the least label of the neighbours and jumps to that label's own label, so the
    rounds grow with the logarithm of the longest path. ``RuntimeError`` if ``most`` rounds do not suffice.
    """
    checkpoint_dir(edges.sparkSession)
    both = edges.select(F.col(a).alias("n"), F.col(b).alias("m")).union(edges.select(F.col(b), F.col(a))).distinct().checkpoint()
    labels = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("c")).checkpoint()
    for _ in range(most):
        near = both.join(labels.withColumnRenamed("n", "m"), "m").groupBy("n").agg(F.min("c").alias("near"))
        step = labels.join(near, "n", "left").select("n", F.least("c", F.coalesce("near", "c")).alias("c1"), "c")
        jump = step.alias("s").join(labels.select(F.col("n").alias("k"), F.col("c").alias("kc")), F.col("s.c1") == F.col("k"), "left")
        new = jump.select(F.col("s.n").alias("n"), F.least("c1", F.coalesce("kc", "c1")).alias("c"), F.col("s.c").alias("old")).checkpoint()
        if new.where("c <> old").isEmpty():
            return new.select("n", F.col("c").alias("component"))
        labels = new.select("n", "c")
    raise RuntimeError("components did not settle")
