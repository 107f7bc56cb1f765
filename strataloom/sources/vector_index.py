"""Vector index as files: versions of normalised vectors beside a manifest that names the one in force.

A build writes its version first and the manifest last, so that a reader sees the old index or the new one
and never a half; a failed build leaves the manifest as it was. The folder must be shared by all executors.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import vectors as V

MANIFEST = "version string, rows long, dimensions int, columns string"


def build(rows: DataFrame, folder: str, vec_col: str = "embedding") -> str:
    """SNK-12: write an index of ``rows`` and put it in force; returns its version. Vectors are brought to
    length 1; null and zero ones are left out. Vectors of different sizes are an error, and the old index stays."""
    spark = rows.sparkSession
    version = f"v{time.time_ns()}"
    unit = rows.where(F.col(vec_col).isNotNull() & (V.norm(F.col(vec_col)) > 0)).withColumn(vec_col, V.unit(F.col(vec_col)))
    unit.write.parquet(f"{folder}/{version}")
    seen = spark.read.parquet(f"{folder}/{version}").agg(F.count("*").alias("n"), F.min(F.size(vec_col)).alias("lo"), F.max(F.size(vec_col)).alias("hi")).first()
    if seen.lo != seen.hi:
        raise ValueError(f"vectors of {seen.lo} to {seen.hi} dimensions")
    line = json.dumps([version, seen.n, seen.hi or 0, json.dumps(rows.columns)])
    spark.createDataFrame([tuple(json.loads(line))], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return version


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-12: the index in force; an error where the files do not hold what the manifest says."""
    m = spark.read.schema(MANIFEST).json(f"{folder}/manifest").first()
    if m is None:
        raise ValueError(f"no index in {folder}")
    index = spark.read.parquet(f"{folder}/{m.version}").select(*json.loads(m.columns))
    if index.count() != m.rows:  # from the files' footers
        raise ValueError(f"the index {m.version} does not have its {m.rows} rows")
    return index
