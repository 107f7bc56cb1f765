"""What several operators need to know of a whole corpus: an even sample of rows to fit models on, and
the lines (headings, running headers) that recur, counted over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: A recurring line must make up this share of all lines counted, so that at most 1 / SHARE lines are
#: known, whatever the size of the corpus: the proven bound of what is sent to the workers.
SHARE = 1e-4


def sampled(df: DataFrame, limit: int, *columns: Column | str, key: str = "doc_id", where: Column | None = None) -> list[Row]:
    """At most ``limit`` rows of ``columns``, spread over the whole table by a hash of ``key`` (of all
    columns where the table has no such column), the same in every run."""
    rows = df if where is None else df.where(where)
    size = rows.count()
    if size > limit:
        of = [key] if key in df.columns else df.columns
        rows = rows.where(F.pmod(F.xxhash64(F.lit(17), *of), F.lit(1 << 40)) < int(limit / size * (1 << 40)))
    return rows.select(*columns).limit(limit).collect()


def recurring(df: DataFrame, fields: list[str], lines: Column, least: int) -> frozenset[str]:
    """Lines that occur in at least ``least`` different texts and are at least ``SHARE`` of all those counted.

    ``lines`` gives the candidate lines (array<string>) of the column ``text``. Each text counts a line
    once and copies of a text count as one, so that a page copied a million times makes no line known.
    """
    texts = df.select(F.explode(F.array(*fields)).alias("text")).where("text is not null")
    found = texts.select(F.xxhash64("text").alias("of"), F.explode(F.array_distinct(lines)).alias("line")).distinct()
    counts = found.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = found.agg(F.count("*").alias("total"))
    known = counts.join(F.broadcast(total)).where(F.col("n") >= SHARE * F.col("total"))  # one row
    return frozenset(r.line for r in known.select("line").collect())
