"""Readers by suffix and exports: rows of sections, JSON, CSV, XML, N-Triples, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes that can be read.
READERS = {"pdf": "pdf", "docx": "docx", "txt": "text", "md": "text", "csv": "csv", "json": "json", "xlsx": "xlsx"}


def reader_of(name: Column) -> Column:
    """Kind of reader for a file name; 'unknown' where the suffix is none of the known ones."""
    table = F.create_map(*(F.lit(x) for pair in READERS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))), F.lit("unknown"))


def read_any(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """A DataFrame of text, CSV, JSON or Parquet files; an unknown kind is an error."""
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    if kind in ("csv", "json", "parquet", "xml", "orc"):
        return spark.read.format(kind).options(**options).load(path)
    raise ValueError(f"no reader for {kind}")


def section_rows(df: DataFrame, key: str, sections: dict[str, Column]) -> DataFrame:
    """Rows (key, section, place, value) of list-valued sections; null and empty lists give none."""
    each = [F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x, i: F.struct(i.alias("place"), x.cast("string").alias("value"))) for items in sections.values()]
    tagged = F.flatten(F.array(*(F.transform(e, _tag(name)) for name, e in zip(sections, each))))
    return df.select(key, F.explode(tagged).alias("r")).select(key, "r.section", "r.place", "r.value")


def _tag(name: str):
    return lambda x: F.struct(F.lit(name).alias("section"), x["place"].alias("place"), x["value"].alias("value"))


def escape_rdf(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")


def ntriples(df: DataFrame, triples: list[tuple[Column, str, Column, bool]]) -> DataFrame:
    """One line for each triple (subject, predicate, object, whether the object is a resource)."""
    line = lambda s, p, o, res: F.concat(F.lit("<"), s, F.lit(f"> <{p}> "), F.concat(F.lit("<"), o, F.lit(">")) if res else F.concat(F.lit('"'), escape_rdf(o), F.lit('"')), F.lit(" ."))
    return df.select(F.explode(F.array(*(line(*t) for t in triples))).alias("line"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns are written as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_xml(df: DataFrame, path: str, row: str = "record") -> None:
    """Characters that a tag must not hold become underscores."""
    import re

    safe = df.toDF(*(re.sub(r"[^A-Za-z0-9_.-]", "_", c) for c in df.columns))
    safe.write.mode("overwrite").format("xml").option("rowTag", row).save(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
