"""Sources and sinks (S), run state (ST), extension surface (X)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import traces
from ..operators import runs as rn
from ..operators import sequences as sq
from ..operators import textindex as ti
from ..oracle import sql
from ..sources import files as fs
from ..sources import provider as pv

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def nested(spark, sf):
    """Trajectories with their steps as one nested row each."""
    s = traces.steps(spark, sf).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "event_type", "k", "reward"))).alias("steps"))
    e = traces.episodes(spark, sf).select("trajectory_id", "sample_id", "method", "repeat_id", "primary_score")
    return e.join(s, "trajectory_id").select("trajectory_id", "sample_id", "method", "repeat_id", "primary_score", "steps")


_FLAT = sql("steps", "SELECT trajectory_id, count(*) AS n_steps, sum(k)::BIGINT AS k_sum FROM steps GROUP BY 1")


def _flat(rows):
    return rows.select("trajectory_id", F.size("steps").cast("long").alias("n_steps"), F.aggregate("steps", F.lit(0).cast("long"), lambda a, x: a + x["k"]).alias("k_sum"))


@query("s01_jsonl_scan", _FLAT)
def s01(spark, sf):
    path = fs.scratch(spark, "jsonl")
    fs.write_jsonl(nested(spark, sf), path)
    return _flat(fs.read_jsonl(spark, path))


def _episode_files(spark, rows):
    path = fs.scratch(spark, "episodes")
    fs.write_episode_files(rows, path)
    return fs.read_episode_files(spark, path).select("trajectory_id", F.size("steps").cast("long").alias("n_steps"))


@query("s02_episode_files", sql("steps", "SELECT trajectory_id, count(*) AS n_steps FROM steps GROUP BY 1"))
@query("s02_episode_files_all", sql("steps", "SELECT trajectory_id, count(*) AS n_steps FROM steps GROUP BY 1"))
def s02(spark, sf):
    """Every episode; both names are of one query."""
    return _episode_files(spark, nested(spark, sf))


@query("s03_recursive_results", sql("episodes", "SELECT method, count(*) AS n, sum(steps)::BIGINT AS steps FROM episodes GROUP BY 1"))
def s03(spark, sf):
    path = fs.scratch(spark, "results")
    traces.episodes(spark, sf).select("method", "sample_id", "steps", (F.col("sample_id") % 3).alias("shard")).write.partitionBy("shard").json(path)
    return fs.read_results(spark, path, "method string, steps long").groupBy("method").agg(F.count("*").alias("n"), F.sum("steps").alias("steps"))


@query("s04_nested_field_scan", sql("steps", "SELECT DISTINCT sample_id AS task_id FROM steps"))
def s04(spark, sf):
    path = fs.scratch(spark, "nested")
    traces.episodes(spark, sf).select(F.struct(F.col("sample_id").alias("task_id"), F.col("trajectory_id").alias("other")).alias("extra_info")).write.parquet(path)
    return fs.read_task_ids(spark, path, "extra_info.task_id").distinct()


@query("s04_dataset_index", sql("episodes", "SELECT row_number() OVER (ORDER BY trajectory_id) - 1 AS dataset_index, sample_id AS task_id FROM episodes"))
def s04_index(spark, sf):
    """Places in a table of several files that was written in the order of the ids."""
    path = fs.scratch(spark, "numbered")
    e = traces.episodes(spark, sf).select("trajectory_id", F.struct(F.col("sample_id").alias("task_id"), F.col("steps").alias("other")).alias("extra_info"))
    e.repartitionByRange(5, "trajectory_id").sortWithinPartitions("trajectory_id").write.parquet(path)
    return fs.read_numbered(spark, path, "extra_info.task_id")


@query("s22_context_provider", "SELECT p_partkey AS goal_index, ['region-guide'] AS skill_ids, (SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) FROM region) AS context FROM part")
def s22(spark, sf):
    """Every goal with the one context of a fixed provider: a text file that Spark has written."""
    path = fs.scratch(spark, "context")
    names = traces.read(spark, sf, "region").coalesce(1).orderBy("r_regionkey")
    names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda r: r["r_name"]), "\n").alias("value")).write.text(path)
    return pv.select_fixed(traces.goals(spark, sf).select("goal_index"), pv.provided(spark, "region-guide", pv.context_of(spark, path)))


@query("s05_goal_range", "SELECT range AS goal_index, r::INTEGER AS repeat_id FROM range(5, 25), (VALUES (0), (1), (2)) t(r)")
def s05(spark, sf):
    return fs.goal_range(spark, 5, 25, 200, (0, 1, 2))


@query("s06_manifest_round_trip", sql("episodes", "SELECT DISTINCT sample_id, repeat_id, method FROM episodes"))
def s06(spark, sf):
    path = fs.scratch(spark, "manifest")
    traces.episodes(spark, sf).select("sample_id", "repeat_id", "method").distinct().write.json(path)
    return fs.read_jsonl(spark, path, "sample_id long, repeat_id int, method string", unique=None)


@query("s07_sorted_sink", sql("episodes", "SELECT trajectory_id, steps FROM episodes"))
def s07(spark, sf):
    path = fs.scratch(spark, "sorted")
    fs.write_jsonl(traces.episodes(spark, sf).select("trajectory_id", "steps"), path)
    return spark.read.schema("trajectory_id string, steps long").json(path)


@query("s08_point_lookup", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey = 3)")
def s08(spark, sf):
    wanted = traces.read(spark, sf, "lineitem").where("l_orderkey = 3").select(F.col("l_partkey").alias("p_partkey"))
    return traces.read(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice").join(wanted, "p_partkey", "left_semi")


_VOCABULARY = rf"w AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(coalesce(text, '')), '{ti.MARKED}', '{ti.PLAIN}'), '{ti.TOKEN}')) AS term FROM documents), {ti.stem_sql('w', 'stems')}"


@query("s09_text_index", sql("", f"{_VOCABULARY} SELECT stem AS term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w JOIN stems USING (term) GROUP BY 1"))
def s09(spark, sf):
    """The table's files as a stream into a new index, four a batch; a second call finds nothing that is new. A call that is interrupted leaves off
    at a batch, as the tests show."""
    path = ti.scratch_index(spark)
    source = f"{sf}/documents.parque[t]"  # a pattern: the table may be one file or a folder of them, and a stream's path must not be a file
    for _ in range(2):
        ti.ingest(spark, source, path, schema="doc_id long, text string", form="parquet", key="doc_id", text="text", files=4)
    return spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _cache(spark, sf):
    v = traces.read(spark, sf, "embeddings")
    return v.select(F.when(F.col("label") % 2 == 0, "small").otherwise("large").alias("model"), F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"), F.col("embedding").alias("vector"))


@query("s10_cache_read", "SELECT sha256(vec_id::VARCHAR) AS content_hash FROM embeddings WHERE label % 2 = 0 AND vec_id % 3 = 0")
def s10(spark, sf):
    hashes = traces.read(spark, sf, "embeddings").where("vec_id % 3 = 0").select(F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"))
    return fs.cached(_cache(spark, sf), "small", hashes).select("content_hash")


@query("s11_cache_upsert", "SELECT CASE WHEN label % 2 = 0 THEN 'small' ELSE 'large' END AS model, count(*) + count(*) FILTER (vec_id % 5 = 0) AS n FROM embeddings GROUP BY 1")
def s11(spark, sf):
    c = _cache(spark, sf)
    extra = traces.read(spark, sf, "embeddings").where("vec_id % 5 = 0").select(F.when(F.col("label") % 2 == 0, "small").otherwise("large").alias("model"), F.sha2(F.concat(F.lit("new"), "vec_id"), 256).alias("content_hash"), F.col("embedding").alias("vector"))
    return fs.upsert(c, extra.unionByName(extra).unionByName(c)).groupBy("model").agg(F.count("*").alias("n"))


@query("s12_append_log", sql("episodes", "SELECT count(*) AS n, count(DISTINCT trajectory_id) AS n_keys FROM episodes"))
def s12(spark, sf):
    path = fs.scratch(spark, "log")
    e = traces.episodes(spark, sf).select("trajectory_id", "steps")
    for r in (0, 1):
        e.where(F.pmod(F.xxhash64("trajectory_id"), F.lit(2)) == r).write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("trajectory_id").alias("n_keys"))


@query("s13_hashed_episode_sink", sql("episodes", "SELECT left(sha256(trajectory_id), 1) AS bucket, count(*) AS n FROM episodes GROUP BY 1"))
def s13(spark, sf):
    path = fs.scratch(spark, "hashed")
    fs.write_by_episode(traces.episodes(spark, sf).select("trajectory_id", "steps"), path)
    return spark.read.schema("trajectory_id string, bucket string").json(path).groupBy("bucket").agg(F.count("*").alias("n"))


@query("s14_graph_sink", sql("nodes", "SELECT count(*) AS n_nodes, round(sum(outcome), 4) AS outcome_sum FROM nodes"))
def s14(spark, sf):
    path = fs.scratch(spark, "graph")
    traces.nodes(spark, sf).write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n_nodes"), F.round(F.sum("outcome"), 4).alias("outcome_sum"))


@query("s15_report_sink", sql("episodes", "SELECT count(DISTINCT method) AS n_rows FROM episodes"))
def s15(spark, sf):
    from ..operators.evaluation import method_summary

    text, markdown = fs.report(method_summary(traces.episodes(spark, sf)), "Methods")
    return spark.createDataFrame([(text, markdown)], "json string, markdown string").select(F.size(F.from_json("json", "array<map<string,string>>")).cast("long").alias("n_rows"))


@query("s16_projected_reload", sql("steps", "SELECT event_type, count(*) AS n FROM steps GROUP BY 1"))
def s16(spark, sf):
    path = fs.scratch(spark, "projected")
    nested(spark, sf).write.parquet(path)
    return spark.read.parquet(path).select(F.explode("steps.event_type").alias("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("s17_compact_reload", "SELECT count(*) AS n, sum(len(embedding))::BIGINT AS values FROM embeddings")
def s17(spark, sf):
    path = fs.scratch(spark, "compact")
    n = traces.nodes(spark, sf).withColumn("embedding", F.col("embedding").cast("array<float>"))
    n.groupBy("trajectory_id").agg(F.collect_list(F.struct("segment_id", "embedding")).alias("segments")).write.parquet(path)
    return spark.read.parquet(path).select(F.explode("segments").alias("s")).agg(F.count("*").alias("n"), F.sum(F.size("s.embedding")).alias("values"))


@query("s18_preprocessed_pool", sql("segments", "SELECT trajectory_id, count(*) AS n_segments FROM segments GROUP BY 1"))
def s18(spark, sf):
    path = fs.scratch(spark, "pool")
    s = sq.segments(traces.steps(spark, sf)).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("start_step", "end_step", "event_type"))).alias("segments"))
    nested(spark, sf).join(s, "trajectory_id").write.parquet(path)
    return spark.read.parquet(path).select("trajectory_id", F.size("segments").cast("long").alias("n_segments"))


def _library(spark, parts, shelf):
    record = F.struct(F.col("p_name").alias("document"), F.array("p_type").alias("tools"))
    payload = parts.groupBy(shelf.alias("shelf")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("part "), "p_partkey"), record)))).alias("payload"))
    return fs.parse_library(payload, "payload").select("name", "content_id")


@query("s19_library_parse", "SELECT 'part ' || p_partkey AS name, 'card_' || left(sha256('part ' || p_partkey || chr(31) || p_name), 16) AS content_id FROM part")
@query("s19_library_parse_all", "SELECT 'part ' || p_partkey AS name, 'card_' || left(sha256('part ' || p_partkey || chr(31) || p_name), 16) AS content_id FROM part")
def s19(spark, sf):
    """Payloads of fifty parts each; both names are of one query."""
    return _library(spark, traces.read(spark, sf, "part"), F.floor(F.col("p_partkey") / 50))


@query("s21_pool_materialisation", sql("episodes", "SELECT count(*) AS n, count(DISTINCT sample_id) AS n_samples FROM episodes WHERE method = 'baseline'"))
def s21(spark, sf):
    from ..operators import validation as va

    path = fs.scratch(spark, "materialised")
    rows = nested(spark, sf).where("method = 'baseline'")
    va.require_empty(va.missing_from_grid(rows.select("sample_id", "repeat_id"), rows.select("sample_id").distinct(), (0, 1)), "pool does not cover its grid")
    fs.write_jsonl(rows, path)
    return fs.read_jsonl(spark, path).agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("n_samples"))


_REPORTED = ("click", "error", "purchase", "signup", "view")


@query("s18_pool_report", sql("segments", "SELECT count(DISTINCT trajectory_id) AS trajectories, count(*) AS segments, max(n_steps) AS longest, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS n_{e}" for e in _REPORTED) + " FROM segments"))
def s18_report(spark, sf):
    """The report of a pool, gathered while it is written."""
    s = sq.segments(traces.steps(spark, sf)).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("start_step", "end_step", "event_type"))).alias("segments"))
    of = lambda e: F.size(F.filter("segments", lambda x: x["event_type"] == e))
    counts = {f"n_{e}": F.sum(of(e)) for e in _REPORTED}
    longest = F.max(F.array_max(F.transform("segments", lambda x: x["end_step"] - x["start_step"] + 1)))
    report = fs.write_pool(nested(spark, sf).join(s, "trajectory_id"), fs.scratch(spark, "pool"), trajectories=F.count("*"), segments=F.sum(F.size("segments")), longest=longest, **counts)
    names = ("trajectories", "segments", "longest", *counts)
    return spark.createDataFrame([tuple(int(report[n]) for n in names)], ", ".join(f"{n} long" for n in names))


# ---- run state


_RESULT = "trajectory_id string, shard int, primary_score double, error string"


@query("st02_checkpoint_resume", sql("episodes", "SELECT count(*) FILTER (steps % 3 = 0) AS completed, count(*) FILTER (steps % 3 <> 0) AS pending FROM episodes"))
def st02(spark, sf):
    """A checkpoint with a line that an interruption cut, and errors, which complete nothing."""
    path = fs.scratch(spark, "checkpoint")
    e = traces.episodes(spark, sf).select("trajectory_id", F.lit(0).alias("shard"), F.col("primary_score"), "steps")
    rn.append(e.where("steps % 3 = 0").select("trajectory_id", "shard", "primary_score", F.lit(None).cast("string").alias("error")), path)
    broken = spark.range(1).select(F.lit('{"trajectory_id": "u0-w').alias("value"))
    broken.write.mode("append").option("lineSep", " ").text(path)
    done = rn.completed(spark, path, _RESULT, ("trajectory_id",))
    left = rn.pending(e.select("trajectory_id"), done, ("trajectory_id",))
    return done.agg(F.count("*").alias("completed")).crossJoin(left.agg(F.count("*").alias("pending")))  # one row each


@query("st03_shard_runner", sql("episodes", "m AS (SELECT *, ((row_number() OVER (ORDER BY trajectory_id) - 1) % 4)::INTEGER AS shard FROM episodes) SELECT shard, count(*) AS selected, count(*) FILTER (steps % 3 = 0) AS skipped, count(*) FILTER (steps % 3 <> 0 AND invalid_actions <= 5) AS completed, count(*) FILTER (steps % 3 <> 0 AND invalid_actions > 5) AS failed FROM m GROUP BY 1"))
def st03(spark, sf):
    """Four shards of which some episodes are done and some fail."""

    def execute(row):
        if row["invalid_actions"] > 5:
            raise ConnectionError("the episode was interrupted")
        return {"trajectory_id": row["trajectory_id"], "shard": row["shard"], "primary_score": row["primary_score"]}

    e = traces.episodes(spark, sf).select("trajectory_id", "steps", "invalid_actions", "primary_score")
    _, _, summary = rn.run_shards(e, e.where("steps % 3 = 0"), execute, key=("trajectory_id",), of=4)
    return summary


# ---- extension surface


@query("x01_rule_table_parser", sql("commands", "SELECT CASE WHEN starts_with(trim(lower(command)), 'go to ') THEN 'move' WHEN starts_with(trim(lower(command)), 'take ') OR starts_with(trim(lower(command)), 'pick ') THEN 'grab' ELSE 'other' END AS action, count(*) AS n FROM commands GROUP BY 1"))
def x01(spark, sf):
    """A parser whose rules are data: the caller's table becomes one column expression."""
    rules = (("go to ", "move"), ("take ", "grab"), ("pick ", "grab"))
    a, out = F.trim(F.lower("command")), F.lit("other")
    for prefix, name in reversed(rules):
        out = F.when(a.startswith(prefix), name).otherwise(out)
    return traces.commands(spark, sf).groupBy(out.alias("action")).agg(F.count("*").alias("n"))


@query("x02_grouped_operator", sql("steps", "SELECT trajectory_id, max(step_index)::BIGINT AS last_step FROM steps GROUP BY 1"))
def x02(spark, sf):
    def last(part):
        return part.groupby("trajectory_id", as_index=False)["step_index"].max().rename(columns={"step_index": "last_step"})

    return traces.steps(spark, sf).select("trajectory_id", "step_index").groupBy("trajectory_id").applyInPandas(last, "trajectory_id string, last_step long")


@query("x03_arrow_scalar_function", sql("steps", "SELECT event_type, sum(length(event_type || k))::BIGINT AS n FROM steps GROUP BY 1"))
def x03(spark, sf):
    @F.pandas_udf("long")
    def width(e: pd.Series, k: pd.Series) -> pd.Series:
        return (e + k.astype(str)).str.len()

    return traces.steps(spark, sf).withColumn("w", width("event_type", "k")).groupBy("event_type").agg(F.sum("w").alias("n"))


@query("x04_ngram_table_function", sql("steps", "x AS (SELECT trajectory_id, event_type || '>' || lead(event_type) OVER (PARTITION BY trajectory_id ORDER BY step_index) AS gram FROM steps) SELECT gram, count(*) AS n FROM x WHERE gram IS NOT NULL GROUP BY 1"))
def x04(spark, sf):
    from pyspark.sql.functions import udtf

    @udtf(returnType="gram: string")
    class Grams:
        def eval(self, seq: list):
            for a, b in zip(seq, seq[1:]):
                yield (f"{a}>{b}",)

    seq = traces.steps(spark, sf).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "event_type"))).alias("s")).select(F.col("s.event_type").alias("seq"))
    seq.createOrReplaceTempView("loomtrace_sequences")
    spark.udtf.register("loomtrace_grams", Grams)
    return spark.sql("SELECT g.gram, count(*) AS n FROM loomtrace_sequences s, LATERAL loomtrace_grams(s.seq) g GROUP BY g.gram")
