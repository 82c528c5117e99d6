"""Handing tasks to the caller's answering function, inside Spark tasks."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def fulfil_tasks(tasks: DataFrame, answer: Callable[[dict], str]) -> DataFrame:
    """Tasks -> document_id, task_id, answer, error.

    ``answer`` gets one task as a dict; how it reaches a service, and how often it tries, is its own matter. What it
    raises becomes the row's error. Rows stay in the partitions of ``tasks``. Write the result to a
    table before using it twice: a second evaluation would call the function again.
    """
    def one(task: dict) -> tuple[str | None, str | None]:
        try:
            return answer(task), None
        except Exception as error:  # noqa: BLE001  a failure belongs to its row
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [one(row) for row in batch.to_dict("records")]
            yield batch[["document_id", "task_id"]].assign(answer=[g[0] for g in got], error=[g[1] for g in got])

    columns = ["document_id", "task_id", "kind", "instructions"]
    return tasks.select(*columns).mapInPandas(run, "document_id string, task_id string, answer string, error string")


def failed(answers: DataFrame) -> DataFrame:
    return answers.filter(F.col("error").isNotNull())
