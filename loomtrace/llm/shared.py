"""Helpers that the corpus operators share: table access, row identity, clashing names, text hygiene; staging is the library's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import delete, digest, drop_staged, keep_until_exit, made, new_path, shared_dir, staged, sweep

__all__ = ["claim", "clean_text", "delete", "digest", "drop_staged", "keep_until_exit", "made", "new_path", "one_of_each", "shared_dir", "staged", "sweep", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, by a path that only Spark's readers need to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this Python worker remembers between tasks, by operator.
_remembered: dict[str, Callable[[], None]] = {}


def claim(operator: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called by an operator as a task of it begins: workers serve one operator after another, so what the others remember is
    dropped. ``forget`` drops what this one remembers."""
    for name in [n for n in _remembered if n != operator]:
        _remembered.pop(name)()
    _remembered[operator] = forget


def clean_text(column: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without(frame: DataFrame, names: list[str]) -> DataFrame:
    """``frame`` without columns of these names, which an operator is about to add: its own columns replace them."""
    own = {n.lower() for n in names}
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns if c.lower() not in own])


def one_of_each(rows: DataFrame, uid: str, *columns: str) -> DataFrame:
    """(uid, columns...): one row of each uid, of rows alike in all columns. Combined before the shuffle."""
    return rows.groupBy(uid).agg(F.first(F.struct(*columns)).alias("row")).select(uid, *[F.col(f"row.{c}").alias(c) for c in columns])
