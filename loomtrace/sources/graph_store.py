"""Graphs on disk: edge measures as a bucketed, sorted table, so that joins and sums by node read it without a shuffle."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import new_path

#: Matrices of the edge algebra, one column each.
MATRICES = ("semantic", "transition", "outcome", "base", "positive", "negative", "adjacency")


def store_matrices(edges: DataFrame, *, buckets: int = 64, path: str | None = None) -> DataFrame:
    """(i, j, matrices...) of undirected edges i < j, written in both directions into ``buckets`` by i, sorted by i and j; returns the stored table.

    It is a table of the session's catalog over files in the shared folder, as only a catalog remembers buckets. Give it about a bucket for each 128 MB."""
    spark = edges.sparkSession
    name = "loomtrace_graph_" + uuid.uuid4().hex
    half = edges.select("i", "j", *MATRICES)
    both = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), *MATRICES))
    both.repartition(buckets, "i").write.bucketBy(buckets, "i").sortBy("i", "j").option("path", path or new_path(spark, "graph")).saveAsTable(name)
    return spark.table(name)


def degrees(stored: DataFrame) -> DataFrame:
    """(i, edges, degree): edges of a node whose adjacency is not zero, and the sum of its absolute values. No shuffle: a node's rows share a bucket."""
    return stored.where("adjacency <> 0").groupBy("i").agg(F.count("*").alias("edges"), F.sum(F.abs("adjacency")).alias("degree"))


def store_spectrum(spark: SparkSession, ids: np.ndarray, values: np.ndarray, vectors: np.ndarray, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(place, eigenvalue) and (segment_id, vector) tables of a spectrum, written and read back."""
    where = path or new_path(spark, "spectrum")
    spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "place int, eigenvalue double").write.parquet(f"{where}/values")
    spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, vectors)], "segment_id long, vector array<double>").write.parquet(f"{where}/vectors")
    return spark.read.parquet(f"{where}/values"), spark.read.parquet(f"{where}/vectors")
