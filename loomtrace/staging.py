"""Tables in the folder that driver and executors share: lineage ends in them, and they outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the names of staged tables begin with.
STAGED = "staged-"
#: The local folder of sessions without a named one, and staged paths of this process that have not been removed.
_local: list[str] = []
_made: set[str] = set()
_session: list[SparkSession] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may name none (tests): it gets a temporary folder. On a cluster that raises."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="loomtrace-"))
            atexit.register(lambda: __import__("shutil").rmtree(_local[0].removeprefix("file://"), ignore_errors=True))
        named = _local[0]
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is removed by :func:`sweep`, or when the process ends."""
    path = f"{shared_dir(spark)}/{STAGED}{label}-{uuid.uuid4().hex}"
    if not _session:
        atexit.register(_sweep_quietly)
    _session[:] = [spark]
    _made.add(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as the machines' own file system has it, if it lies there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.toUri().getPath() if at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file" else None


def drop_staged(df: DataFrame) -> None:
    """Remove the staged table that ``df`` reads (a result of :func:`staged` that nothing reads any more)."""
    files = df.inputFiles()[:1]
    for path in [p for p in _made for f in files if p.rsplit("/", 1)[1] in f]:
        delete(df.sparkSession, path)
        _made.discard(path)


def made() -> frozenset[str]:
    """The staged tables of this process that are there now."""
    return frozenset(_made)


def sweep(spark: SparkSession, keep: frozenset[str] = frozenset()) -> None:
    """Remove the staged tables that this process has made, but for those to ``keep`` (what :func:`made` gave before). Only for
    callers that have written what they need."""
    for path in _made - keep:
        delete(spark, path)
        _made.discard(path)


def _sweep_quietly() -> None:
    """What is left when the process ends, if the session's JVM still answers."""
    try:
        sweep(_session[0])
    except Exception:  # noqa: BLE001 - the process ends; the folder's owner removes the rest
        pass


def keep_until_exit(path: str, spark: SparkSession) -> None:
    """Have a path in the shared folder removed when the process ends."""
    if not _session:
        atexit.register(_sweep_quietly)
    _session[:] = [spark]
    _made.add(path)


def digest(*columns: Column | str) -> Column:
    """128 bits of SHA-256 over the columns' values and nulls: rows alike in all of them, and no others, share it."""
    return F.unhex(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 32))


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 in the given order. The rows are dealt by ranges of the order, counted by partition, and
    numbered within it, so no task sees more than a range."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted(kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    starts = rows.sparkSession.createDataFrame(before, "p long, before long")
    joined = kept.join(F.broadcast(starts), part == F.col("p"))
    return joined.withColumn(name, F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "p", "before")
