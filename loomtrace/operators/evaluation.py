"""Evaluation: pairing, audits, aggregates, bootstrap and exact tests over episode tables."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import numbered

KEY = ("sample_id", "repeat_id")


def paired(episodes: DataFrame, baseline: str = "baseline", candidate: str = "candidate") -> DataFrame:
    """One row per (sample_id, repeat_id) with the columns of both methods (base_*, cand_*)."""
    side = lambda m, p: episodes.where(F.col("method") == m).select(*KEY, *[F.col(c).alias(p + c) for c in episodes.columns if c not in KEY])
    return side(baseline, "base_").join(side(candidate, "cand_"), list(KEY))


def unpaired(episodes: DataFrame, baseline: str = "baseline", candidate: str = "candidate") -> DataFrame:
    """Keys that only one of the methods has: the rows that a strict pairing refuses."""
    flag = episodes.where(F.col("method").isin(baseline, candidate)).groupBy(*KEY).agg(F.bool_or(F.col("method") == baseline).alias("in_baseline"), F.bool_or(F.col("method") == candidate).alias("in_candidate"))
    return flag.where("not (in_baseline and in_candidate)")


def saving(base: str = "base_steps", cand: str = "cand_steps") -> Column:
    return (F.col(base) - F.col(cand)) / F.greatest(F.col(base), F.lit(1))


def guarded_saving() -> Column:
    """Relative step saving of a pair; not above 0 where the outcome got worse."""
    worse = F.col("cand_success").cast("int") < F.col("base_success").cast("int")
    return F.when(worse, F.least(saving(), F.lit(0.0))).otherwise(saving())


def usage(column: str) -> list[Column]:
    """Coverage, sum (0 of none) and mean (null of none) of a nullable measure."""
    return [(F.count(column) / F.count("*")).alias(f"{column}_coverage"), F.coalesce(F.sum(column), F.lit(0)).alias(f"{column}_sum"), F.avg(column).alias(f"{column}_mean")]


def method_summary(episodes: DataFrame) -> DataFrame:
    """Measures of each method; the invalid rate is pooled over steps, not a mean of ratios."""
    return episodes.groupBy("method").agg(
        F.count("*").alias("n_episodes"), F.count_distinct("sample_id").alias("n_samples"), F.round(F.avg("primary_score"), 6).alias("mean_score"), F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.avg("steps").alias("mean_steps"), (F.sum("invalid_actions") / F.greatest(F.sum("steps"), F.lit(1))).alias("invalid_rate"), F.avg(F.when(F.col("success"), F.col("steps"))).alias("mean_steps_of_success"), *usage("billable_tokens"),
    )


def task_means(episodes: DataFrame, measure: Column) -> DataFrame:
    """Mean of task means: repeats are averaged within a task first."""
    tasks = episodes.groupBy("method", "sample_id").agg(F.avg(measure).alias("m"))
    return tasks.groupBy("method").agg(F.round(F.avg("m"), 6).alias("task_mean"), F.count("*").alias("n_tasks"))


def mcnemar(wins: Column, losses: Column) -> Column:
    """Exact two-sided p: twice the binomial tail, at most 1. The tail is its largest term, as a sum of logarithms, times the sum of all terms over
    it, so nothing overflows or underflows however many pairs differ."""
    n, k = wins + losses, F.least(wins, losses)
    step = lambda s, i: F.struct((s["log"] + F.log((n - i + 1) / i)).alias("log"), (s["sum"] * i / (n - i + 1) + 1).alias("sum"))
    seq = F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct((n * math.log(0.5)).alias("log"), F.lit(1.0).alias("sum"))
    tail = F.aggregate(seq, start, step, lambda s: F.exp(s["log"]) * s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def pearson(a: str, b: str) -> Column:
    """Correlation; null (not an error) where one side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


#: Task values are held as one array up to so many; beyond it the draws meet them in a join.
HELD = 1_000_000


def _block_states(n: int, samples: int, seed: int, batch: int) -> list[tuple[int, int, bytes]]:
    """(first sample, samples, state of the generator before them) of each block: every draw is made once here, so no block has to
    repeat those before it."""
    rng, out = np.random.default_rng(seed), []
    for first in range(0, samples, batch):
        size = min(batch, samples - first)
        out.append((first, size, pickle.dumps(rng.bit_generator.state)))
        for _ in range(size if first + batch < samples else 0):
            rng.integers(0, n, size=n)
    return out


def _resampled(spark: SparkSession, n: int, samples: int, seed: int, batch: int, use: Callable[[int, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``use(b, draws)`` for every sample b, its draws of n tasks as numpy's PCG64 gives them row by row, in blocks."""
    blocks = spark.createDataFrame(_block_states(n, samples, seed, batch), "first long, size long, state binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for first, size, state in part.itertuples(index=False, name=None):
                rng = np.random.default_rng()
                rng.bit_generator.state = pickle.loads(bytes(state))
                for b in range(first, first + size):
                    yield use(b, rng.integers(0, n, size=n))

    return blocks.repartition(max(1, min(200, -(-samples // batch)))).mapInPandas(run, schema)


def resample_counts(spark: SparkSession, n: int, samples: int, seed: int, batch: int = 64) -> DataFrame:
    """(b, task, times): how often each sample draws each of n tasks."""

    def use(b: int, draws: np.ndarray) -> pd.DataFrame:
        task, times = np.unique(draws, return_counts=True)
        return pd.DataFrame({"b": b, "task": task, "times": times})

    return _resampled(spark, n, samples, seed, batch, use, "b long, task long, times long")


def bootstrap_means(tasks: DataFrame, value: str = "value", *, samples: int = 1000, seed: int = 42, batch: int = 512, order: str = "sample_id", held: int = HELD) -> DataFrame:
    """(b, mean): task-resampled means, drawn as numpy's PCG64 draws them, whether the draws come in batches, as one matrix or as
    choices: those streams are one and the same.

    Task means travel once, as one array, if they are at most ``held``; of more the draws are counted and joined with them."""
    spark = tasks.sparkSession
    n = tasks.count()
    if n == 0:
        raise ValueError("no tasks to resample")
    if n > held:
        placed = numbered(tasks.select(order, F.col(value).cast("double").alias("v")), order, name="task")
        drawn = resample_counts(spark, n, samples, seed).hint("merge").join(placed, "task")
        return drawn.groupBy("b").agg((F.sum(F.col("v") * F.col("times")) / n).alias("mean"))
    values = np.array([r[0] for r in tasks.orderBy(order).select(F.col(value).cast("double")).collect()])
    shared = spark.sparkContext.broadcast(values)
    return _resampled(spark, n, samples, seed, batch, lambda b, draws: pd.DataFrame({"b": [b], "mean": [shared.value[draws].mean()]}), "b long, mean double")


def interval(means: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Linear-interpolated quantiles of resampled means."""
    return means.agg(F.percentile("mean", low).alias("ci_low"), F.percentile("mean", high).alias("ci_high"), F.percentile("mean", 0.05).alias("one_sided_low"), F.count("*").alias("samples"))
