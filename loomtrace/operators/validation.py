"""Constraints as queries: every rule returns the rows that break it; strict callers raise if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_empty(rows: DataFrame, what: str) -> None:
    found = rows.take(3)
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def gaps(steps: DataFrame) -> DataFrame:
    """Trajectories whose step indices are not 0..n-1."""
    g = steps.groupBy("trajectory_id").agg(F.min("step_index").alias("lo"), F.max("step_index").alias("hi"), F.count("*").alias("n"), F.count_distinct("step_index").alias("d"))
    return g.where("lo <> 0 or hi <> n - 1 or d <> n")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the name of each rule that they break; a rule that is null counts as kept."""
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("rule", F.explode(broken))


def missing_from_grid(rows: DataFrame, samples: DataFrame, repeats: tuple[int, ...]) -> DataFrame:
    """Cells of samples times repeats without a row."""
    grid = samples.withColumn("repeat_id", F.explode(F.array(*[F.lit(r) for r in repeats])))
    return grid.join(rows, ["sample_id", "repeat_id"], "left_anti")


def not_partitioned(members: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments that lie in no cluster or in several."""
    n = members.groupBy("segment_id").agg(F.count("*").alias("n"))
    return segments.select("segment_id").join(n, "segment_id", "full_outer").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")


def dangling(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """References without a target."""
    return child.join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def shared_ids(parts: DataFrame, key: str, part: str) -> DataFrame:
    """Ids that lie in more than one part."""
    return parts.groupBy(key).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def mixed(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Keys under which a column should be constant and is not."""
    return rows.groupBy(key).agg(F.count_distinct(column).alias("values")).where("values > 1")


def wrong_set(rows: DataFrame, key: tuple[str, ...], column: str, wanted: tuple[str, ...]) -> DataFrame:
    """Keys whose values of a column are not exactly the wanted ones."""
    found = rows.groupBy(*key).agg(F.count_distinct(column).alias("n"), F.count_distinct(F.when(F.col(column).isin(*wanted), F.col(column))).alias("of_them"))
    return found.where((F.col("n") != len(wanted)) | (F.col("of_them") != len(wanted))).select(*key)


def contract_breaks(old: DataFrame, new: DataFrame, key: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """(key, field, old, new): fields of a run's contract in which the run that extends it differs; nulls are values."""
    theirs = new.select(*key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_new"))
    mine = old.select(*key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_old"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_old.{f}").alias("old"), F.col(f"_new.{f}").alias("new")) for f in fields])
    flat = mine.join(theirs, list(key)).select(*key, F.inline(each))
    return flat.where(~F.col("old").eqNullSafe(F.col("new")))


def bad_dimensions(index: DataFrame, key: str, vector: str) -> DataFrame:
    """Ids whose vector is empty or not of the first id's length, and ids that repeat."""
    first = index.agg(F.min_by(F.size(vector), key).alias("want"))
    twice = duplicates(index, key).select(key)
    sized = index.select(key, F.size(vector).alias("n")).crossJoin(F.broadcast(first))  # one row
    return sized.where("n = 0 or n <> want").select(key).unionByName(twice).distinct()


def chained_digest(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row: SHA-256 over the rows' digests in key order (frozen reports: small tables)."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]), 256)
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), digest.alias("d")))), lambda s: s["d"]), ""), 256).alias("digest"), F.count("*").alias("n"))
