"""Sequence operators over ordered steps: run-length segments, compression, n-grams, contexts, shards.

All of them partition by trajectory, so a plan shares one exchange for several of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import numbered


def by_step(trajectory: str = "trajectory_id", order: str = "step_index"):
    return Window.partitionBy(trajectory).orderBy(order)


def runs(steps: DataFrame, label: str = "event_type") -> DataFrame:
    """Adds ``run``: the number of the run of equal labels that a step lies in, from 1."""
    w = by_step()
    fresh = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & F.lag("step_index").over(w).isNotNull(), 0).otherwise(1)
    return steps.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w)).drop("_fresh")


def segments(steps: DataFrame, *more: Column) -> DataFrame:
    """Closed segments [start_step, end_step] of equal consecutive events, with step count and further aggregates."""
    keys = [c for c in ("trajectory_id", "sample_id", "method", "repeat_id", "event_type") if c in steps.columns]
    g = runs(steps).groupBy(*keys, "run").agg(F.min("step_index").alias("start_step"), F.max("step_index").alias("end_step"), F.count("*").alias("n_steps"), *more).drop("run")
    return g.withColumn("segment_id", F.concat(F.col("trajectory_id"), F.lit(":segment:"), F.col("start_step"), F.lit("-"), F.col("end_step")))


def with_context(segs: DataFrame) -> DataFrame:
    """Adds previous_event (START) and next_event (END)."""
    w = by_step(order="start_step")
    return segs.withColumn("previous_event", F.lag("event_type", 1, "START").over(w)).withColumn("next_event", F.lead("event_type", 1, "END").over(w))


def sequences(segs: DataFrame, label: str = "event_type", order: str = "start_step", key: str = "trajectory_id") -> DataFrame:
    """(key, seq): labels in order, equal neighbours compressed to one."""
    s = segs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, label))).alias("s")).select(key, F.col(f"s.{label}").alias("seq"))
    return s.select(key, compressed(F.col("seq")).alias("seq"))


def compressed(seq: Column) -> Column:
    return F.filter(seq, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(seq, i - 1)))


def ngrams(seq: Column, longest: int) -> Column:
    """Distinct contiguous n-grams of 2 to ``longest`` labels with at least two different ones."""
    none = F.array().cast("array<array<string>>")
    of = lambda n: F.when(F.size(seq) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(seq) - n + 1, F.lit(1))), lambda i: F.slice(seq, i, n))).otherwise(none)
    return F.filter(F.array_distinct(F.concat(*[of(n) for n in range(2, longest + 1)])), lambda p: F.size(F.array_distinct(p)) >= 2)


def pairs(segs: DataFrame, label: str = "event_type") -> DataFrame:
    """Adjacent pairs (source, target) of segments."""
    w = by_step(order="start_step")
    return segs.select("trajectory_id", "start_step", F.col(label).alias("source"), F.lead(label).over(w).alias("target")).where("target is not null")


def anchor(seq: Column, path: Column) -> Column:
    """First index, from 0, at which ``path`` occurs in ``seq``; null if it does not."""
    last = F.size(seq) - F.size(path)
    index = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.array_min(F.filter(index, lambda i: F.slice(seq, i + 1, F.size(path)) == path))


def shards(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Round-robin shard of each manifest row in the given order, numbered range by range."""
    return numbered(rows, *order).withColumn("shard", (F.col("place") % n).cast("int")).drop("place")
