"""Manifests: seeded selections and partitions of sample ids."""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import numbered, staged

def _order(ids: DataFrame, seed: int, column: str) -> DataFrame:
    """ids with ``place``, their position from 0 in the order that Python's seeded shuffle of the sorted ids gives, at any number.

    The shuffle moves positions alone, in one task (8 bytes each), and is joined with the ids' own positions."""
    spark = ids.sparkSession
    sorted_ids = numbered(ids.select(column), column, name="_index")
    n = sorted_ids.count()

    def shuffled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            at = array("q", range(n))
            random.Random(seed).shuffle(at)
            for k in range(0, n, 65_536):
                yield pd.DataFrame({"_index": at[k : k + 65_536], "place": range(k, min(k + 65_536, n))})

    places = spark.range(0, 1, 1, 1).mapInPandas(shuffled, "_index long, place long")
    return sorted_ids.join(staged(places, "places"), "_index").select(column, "place")


def partition(ids: DataFrame, sizes: dict[str, int], *, seed: int, column: str = "sample_id") -> DataFrame:
    """Disjoint parts of the given sizes in the seeded order; ids beyond their sum are left out."""
    placed = _order(ids, seed, column)
    out, at = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        out = F.when((F.col("place") >= at) & (F.col("place") < at + n), name).otherwise(out)
        at += n
    return placed.select(column, out.alias("part")).where("part is not null")


def selections(ids: DataFrame, *, seeds: tuple[int, ...], size: int, column: str = "sample_id") -> DataFrame:
    """One selection a seed; what one has taken is left out of the next."""
    left, out = ids, None
    for seed in seeds:
        taken = _order(left, seed, column).where(F.col("place") < size).select(column, F.lit(seed).alias("seed"))
        out = taken if out is None else out.unionByName(taken)
        left = left.join(taken, column, "left_anti")
    return out


def expand(samples: DataFrame, repeats: tuple[int, ...]) -> DataFrame:
    """Samples times repeats; repeats must differ and not be negative. A handful of literal repeats is exploded, no join."""
    if len(set(repeats)) != len(repeats) or min(repeats, default=0) < 0:
        raise ValueError("repeats must be unique and not negative")
    return samples.dropDuplicates().withColumn("repeat_id", F.explode(F.array(*[F.lit(r) for r in repeats])))
