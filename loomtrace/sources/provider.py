"""A fixed context as a data source: ``spark.read.format("loomtrace_context")`` gives one skill and its context for every task.

Options: ``skill_id`` and ``context``, both not blank. :func:`context_of` reads a context from a text file by a path that only Spark need understand.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Characters of a context at most: it goes with every task's plan.
LONGEST = 1 << 20


class _Reader(DataSourceReader):
    def __init__(self, skill_id: str, context: str):
        self.row = (skill_id, context)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield self.row


class ContextSource(DataSource):
    """(skill_id, context), one row."""

    @classmethod
    def name(cls) -> str:
        return "loomtrace_context"

    def schema(self) -> str:
        return "skill_id string, context string"

    def reader(self, schema) -> DataSourceReader:
        skill_id, context = self.options.get("skill_id", ""), self.options.get("context", "").strip()
        if not skill_id or not context:
            raise ValueError("skill id and context must not be empty")
        if len(context) > LONGEST:
            raise ValueError(f"a context has at most {LONGEST} characters")
        return _Reader(skill_id, context)


def context_of(spark: SparkSession, path: str) -> str:
    """The text of one file, at most ``LONGEST`` characters."""
    row = spark.read.text(path, wholetext=True).select(F.length("value").alias("n"), F.substring("value", 1, LONGEST + 1).alias("text")).first()
    if row is None or row["n"] > LONGEST:
        raise ValueError(f"a context is one file of at most {LONGEST} characters")
    return row["text"]


def provided(spark: SparkSession, skill_id: str, context: str) -> DataFrame:
    spark.dataSource.register(ContextSource)
    return spark.read.format("loomtrace_context").option("skill_id", skill_id).option("context", context).load()


def select_fixed(goals: DataFrame, provider: DataFrame) -> DataFrame:
    """Every goal with the provider's selection: the ids selected, and their context."""
    return goals.crossJoin(F.broadcast(provider)).select(*goals.columns, F.array("skill_id").alias("skill_ids"), "context")  # one row
