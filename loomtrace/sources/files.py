"""Readers and writers of episode records: JSON lines, one JSON file an episode, nested Parquet, manifests, reports, caches."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..operators import validation as va
from ..staging import mounted, new_path

STEP = "struct<step_index:int,event_type:string,k:int,reward:double>"
TRAJECTORY = f"trajectory_id string, sample_id long, method string, repeat_id int, primary_score double, steps array<{STEP}>"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    return new_path(spark, label)


def read_jsonl(spark: SparkSession, path: str, schema: str = TRAJECTORY, *, unique: str | None = "trajectory_id") -> DataFrame:
    """JSON lines by a fixed schema; a malformed line fails, blank lines are skipped, a repeated id raises."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if unique:
        va.require_empty(va.duplicates(rows, unique), f"duplicate {unique}")
    return rows


def write_jsonl(rows: DataFrame, path: str, order: str = "trajectory_id") -> None:
    """Sorted JSON lines; Spark's commit makes the folder appear as a whole."""
    rows.orderBy(order).write.mode("overwrite").json(path)


def write_episode_files(rows: DataFrame, path: str, key: str = "trajectory_id") -> None:
    """One JSON document a file; a repeated id raises.

    On a mounted folder tasks write the files by themselves, named by the hash of the id, in folders by its first digits: Spark's writer starts
    several processes a file there, to set its permissions and those of its checksum. A file appears as a whole, and a task that is repeated
    writes the same again. In other stores Spark's writer makes a file a row."""
    rows = rows.select(F.sha2(key, 256).alias("name"), F.to_json(F.struct(*rows.columns)).alias("value")).repartition("name").sortWithinPartitions("name")
    folder = mounted(rows.sparkSession, path)
    if folder is None:
        va.require_empty(va.duplicates(rows, "name"), f"duplicate {key}")
        rows.select("value").write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)
        return

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = "", 0
        for part in parts:
            for name, value in zip(part.column("name").to_pylist(), part.column("value").to_pylist()):
                if name == last:
                    raise ValueError(f"duplicate {key}")
                at = f"{folder}/{name[:2]}"
                if name[:2] != last[:2]:
                    os.makedirs(at, exist_ok=True)
                last, n, hidden = name, n + 1, f"{at}/.{name}-{uuid.uuid4().hex}"
                with open(hidden, "wb") as f:
                    f.write(value.encode())
                os.replace(hidden, f"{at}/{name}.json")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.mapInArrow(write, "n long").agg(F.sum("n")).first()
    os.makedirs(folder, exist_ok=True)  # no rows, no task that makes it


def read_episode_files(spark: SparkSession, path: str, schema: str = TRAJECTORY) -> DataFrame:
    """One JSON document a file, with the file's name, in no order.

    On a mounted folder the driver lists the folders in it alone; tasks list and read what lies in them, so that no file has a status on the
    driver. In other stores Spark's reader lists every file there."""
    folder = mounted(spark, path)
    if folder is not None:
        return _read_mounted(spark, folder, schema)
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,txt}")
    return files.json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


#: Bytes of files that a task reads before it passes them on.
READ_BYTES = 4 << 20


def _read_mounted(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What Spark's reader gives of the JSON documents under a folder, by tasks that list and read a folder each."""
    seen = lambda name: not name.startswith(("_", "."))
    with os.scandir(folder) as entries:
        parts = sorted(e.path for e in entries if seen(e.name) and e.is_dir())
    # What lies in the folder itself is one more part.
    places = spark.createDataFrame([(folder, False), *((p, True) for p in parts)], "at string, deep boolean").repartition(len(parts) + 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, deep in zip(b.column("at").to_pylist(), b.column("deep").to_pylist()):
                held, names, texts = 0, [], []
                for file in _files(at, deep):
                    with open(file, "rb") as f:
                        raw = f.read()
                    held += len(raw)
                    names.append(_ASKEW.sub(lambda c: quote(c[0], safe=""), os.path.basename(file)))
                    texts.append(raw.decode(json.detect_encoding(raw), "replace"))
                    if held >= READ_BYTES:
                        yield pa.RecordBatch.from_pydict({"file": names, "value": texts})
                        held, names, texts = 0, [], []
                if names:
                    yield pa.RecordBatch.from_pydict({"file": names, "value": texts})

    texts = places.mapInArrow(read, "file string, value string").where(F.trim(F.translate("value", "\t\r\n", "   ")) != "")
    kind = spark.createDataFrame([], schema).schema
    none = F.array(F.lit(None).cast(kind))  # a malformed document gives a row of nulls
    rows = texts.select("file", F.explode(F.coalesce(F.from_json("value", ArrayType(kind)), none)).alias("r"))
    return rows.select("r.*", "file")


#: What a file's name doesn't keep as it is in its URI.
_ASKEW = re.compile(r"[^\w\x80-\U0010ffff!$&'()*+,;=:@~.-]", re.ASCII)


def _files(at: str, deep: bool) -> Iterator[str]:
    """JSON and text files in a folder, and in those below it."""
    with os.scandir(at) as entries:
        for e in entries:
            if e.name.startswith(("_", ".")):
                continue
            if e.is_dir():
                if deep:
                    yield from _files(e.path, True)
            elif e.name.endswith((".json", ".txt")):
                yield e.path


def read_results(spark: SparkSession, root: str, schema: str, name: str = "*.json") -> DataFrame:
    """All result files under a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)


def write_by_episode(rows: DataFrame, path: str, key: str = "trajectory_id") -> None:
    """Partitioned by the first digits of the id's hash, which names an episode whatever characters its id has."""
    hashed = rows.withColumn("episode_hash", F.sha2(key, 256)).withColumn("bucket", F.substring("episode_hash", 1, 1))
    hashed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def read_task_ids(spark: SparkSession, path: str, field: str) -> DataFrame:
    """One nested field of a Parquet table; the scan reads that leaf alone. :func:`read_numbered` has the rows' places as well."""
    return spark.read.parquet(path).select(F.col(field).alias("task_id"))


def read_numbered(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """(dataset_index, columns...): a Parquet table's rows by their place in the order of its files and within them.

    The reader's own position column gives the place within a file; the sizes of the files before it (one row a file) the rest. Files are in the
    order of their paths, which is that of a writer's tasks."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), *columns)
    sizes = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_file").alias("_of"), before.alias("_before"))
    names = [c.rsplit(".", 1)[-1] for c in columns]
    return rows.join(starts, F.col("_file") == F.col("_of")).select((F.col("_before") + F.col("_row")).alias("dataset_index"), *names)


def write_pool(rows: DataFrame, path: str, **metrics: Column) -> dict:
    """Write a pool of trajectories, and return its report: metrics gathered as the rows are written, not by reading them again. Metrics must be
    aggregates; a task that is repeated does not count twice, as those of the job that committed are taken."""
    seen = Observation()
    rows.observe(seen, *[m.alias(n) for n, m in metrics.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def goal_range(spark: SparkSession, start: int, end: int, size: int, repeats: tuple[int, ...]) -> DataFrame:
    """Goal indices [start, end) within [0, size), times repeats."""
    if not 0 <= start < end <= size:
        raise ValueError("goal range out of bounds")
    return spark.range(start, end).select(F.col("id").alias("goal_index"), F.explode(F.array(*[F.lit(r) for r in repeats])).alias("repeat_id"))


def cached(cache: DataFrame, model: str, hashes: DataFrame) -> DataFrame:
    """Vectors of a model for wanted content hashes."""
    return cache.where(F.col("model") == model).join(hashes, "content_hash", "left_semi")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with rows of unknown (model, content_hash): what is there stays, of new rows of one key the smallest counts."""
    fresh = new.groupBy("model", "content_hash").agg(F.min("vector").alias("vector")).join(cache, ["model", "content_hash"], "left_anti")
    return cache.unionByName(fresh.select(*cache.columns))


def report(rows: DataFrame, title: str, most: int = 200) -> tuple[str, str]:
    """(JSON, Markdown) of a small report table."""
    got = [r.asDict() for r in rows.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "-|" * len(rows.columns)
    lines = ["| " + " | ".join(str(r[c]) for c in rows.columns) + " |" for r in got]
    return json.dumps(got, default=str, sort_keys=True), "\n".join([f"# {title}", "", head, *lines])


def parse_library(payload: DataFrame, column: str) -> DataFrame:
    """(name, document, content_id) of a JSON object of records, one row a record."""
    m = F.from_json(column, "map<string,struct<document:string,tools:array<string>>>")
    e = payload.select(F.explode(m).alias("name", "r"))
    return e.select("name", F.col("r.document").alias("document"), F.col("r.tools").alias("tools"), F.concat(F.lit("card_"), F.substring(F.sha2(F.concat_ws("\x1f", "name", "r.document"), 256), 1, 16)).alias("content_id"))
