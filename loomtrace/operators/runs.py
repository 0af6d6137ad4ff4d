"""Resumable runs: checkpoints of results and errors as JSON lines, and shards of episodes that are attempted once each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .sequences import shards
from .validation import duplicates, require_empty


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of a folder of logs. What follows the last line end of a file was never finished, so it is left out."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    return whole.select("file", F.explode(F.slice("lines", 1, F.size("lines") - 1)).alias("line")).where(F.trim("line") != "")


def completed(spark: SparkSession, path: str | None, schema: str, key: tuple[str, ...]) -> DataFrame:
    """Results of a checkpoint. A broken line raises, and so does a key that is there twice, a result without a score, or with an error."""
    if path is None:
        return spark.createDataFrame([], schema)
    rows = log_lines(spark, path).select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    require_empty(duplicates(rows, *key), "a checkpoint holds a key twice")
    require_empty(rows.where(F.col("primary_score").isNull() | F.col("error").isNotNull()), "a checkpoint holds what is no result")
    return rows


def pending(selected: DataFrame, done: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Selected episodes without a result; an error alone leaves an episode pending."""
    return selected.join(done.select(*key), list(key), "left_anti")


def run_shards(
    manifest: DataFrame, done: DataFrame, execute: Callable[[dict], dict], *, key: tuple[str, ...], of: int, which: tuple[int, ...] | None = None, most: int | None = None, dry_run: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, errors, summary) of the pending episodes of some of ``of`` round-robin shards.

    ``execute`` gets the manifest row with its shard and returns key columns, shard and primary_score; an exception, another key
    or another shard is an error of that episode alone. Both tables are staged, so an episode that succeeds is attempted once
    whatever reads them; append them with :func:`append`. The summary counts selected, skipped, completed and failed by shard."""
    if most is not None and most <= 0:
        raise ValueError("at least one episode must be allowed")
    chosen = shards(manifest, of, *key)
    chosen = chosen.where(F.col("shard").isin(list(which))) if which is not None else chosen
    if most is not None:
        chosen = chosen.orderBy(*key).limit(most)
    chosen = staged(chosen, "selected")
    left = pending(chosen, done, key)
    kinds = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in key)

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                own = [row[c] for c in key]
                try:
                    got = execute(row)
                    if [got[c] for c in key] != own or got["shard"] != row["shard"]:
                        raise ValueError("the result is of another episode or shard")
                    out.append([*own, row["shard"], float(got["primary_score"]), None])
                except Exception as e:  # noqa: BLE001 - whatever an episode raises is its error record
                    out.append([*own, row["shard"], None, f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(out, columns=[*key, "shard", "primary_score", "error"])

    schema = f"{kinds}, shard int, primary_score double, error string"
    tried = manifest.sparkSession.createDataFrame([], schema) if dry_run else staged(left.mapInPandas(attempt, schema), "attempts")
    counts = chosen.groupBy("shard").agg(F.count("*").alias("selected")).join(left.groupBy("shard").agg(F.count("*").alias("left")), "shard", "left")
    ended = tried.groupBy("shard").agg(F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    summary = counts.join(ended, "shard", "left").select("shard", "selected", (F.col("selected") - F.coalesce("left", F.lit(0))).alias("skipped"), zero("completed"), zero("failed"))
    return tried.where("error is null"), tried.where("error is not null").drop("primary_score"), summary


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a log as JSON lines; Spark's commit makes all of them appear at once, or none."""
    rows.write.mode("append").option("ignoreNullFields", False).json(path)
