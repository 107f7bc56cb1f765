"""Calls of an outside service in batches, within the tasks that hold the rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answered(df: DataFrame, call: Callable[[list[str]], dict[str, str]], id_col: str, text_col: str, size: int = 16) -> DataFrame:
    """RES-27: rows (id, answer, failure) of ``call``, which takes a list of texts and returns the answers it has.

    Each task keeps a queue of jobs. A job that fails is put back in two parts; a text that fails alone,
    or that answers omit twice, comes out with the reason as its failure, so no row vanishes. A lost
    connection ends the task, which Spark repeats. Equal texts of a batch are sent once; null texts have
    a null answer.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = list(dict.fromkeys(t for t in part["text"].tolist() if t is not None))
            answers: dict[str, str] = {}
            failures: dict[str, str] = {}
            jobs = deque((texts[i : i + size], False) for i in range(0, len(texts), size))
            while jobs:
                job, again = jobs.popleft()
                try:
                    got = call(job)
                except ConnectionError:
                    raise
                except Exception as reason:  # noqa: BLE001 - whatever the service raises
                    if len(job) == 1:
                        failures[job[0]] = str(reason) or type(reason).__name__
                    jobs.extend((job[k::2], again) for k in (0, 1) if len(job) > 1)
                    continue
                answers.update((t, got[t]) for t in job if t in got)
                omitted = [t for t in job if t not in got]
                if omitted and again:
                    failures.update(dict.fromkeys(omitted, "omitted"))
                elif omitted:
                    jobs.append((omitted, True))
            yield pd.DataFrame({"id": part["id"], "answer": part["text"].map(answers), "failure": part["text"].map(failures)})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, answer string, failure string")
