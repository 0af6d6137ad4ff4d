"""Constraints as queries (V): each returns offending rows, counted per rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import traces
from ..operators import sequences as sq
from ..operators import validation as va
from ..oracle import sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


@query("v01_unique_keys", sql("episodes", "e AS (SELECT trajectory_id FROM episodes UNION ALL SELECT trajectory_id FROM episodes WHERE steps % 17 = 0) SELECT trajectory_id, count(*) AS n FROM e GROUP BY 1 HAVING count(*) > 1"))
def v01(spark, sf):
    e = traces.episodes(spark, sf)
    return va.duplicates(e.select("trajectory_id").unionByName(e.where("steps % 17 = 0").select("trajectory_id")), "trajectory_id")


@query("v02_contiguous_steps", sql("steps", "SELECT trajectory_id FROM steps WHERE NOT (step_index = 3 AND k % 4 = 0) GROUP BY 1 HAVING min(step_index) <> 0 OR max(step_index) <> count(*) - 1"))
def v02(spark, sf):
    return va.gaps(traces.steps(spark, sf).where("not (step_index = 3 and k % 4 = 0)")).select("trajectory_id")


@query("v03_result_rules", sql("episodes", "SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT steps <= 22 THEN 'step bound' END, CASE WHEN NOT primary_score BETWEEN 0 AND 1 THEN 'score range' END, CASE WHEN NOT invalid_actions <= 6 THEN 'too many invalid' END], lambda x: x IS NOT NULL)) AS rule FROM episodes) GROUP BY 1"))
def v03(spark, sf):
    rules = {"step bound": F.col("steps") <= 22, "score range": F.col("primary_score").between(0, 1), "too many invalid": F.col("invalid_actions") <= 6}
    return va.violations(traces.episodes(spark, sf), rules).groupBy("rule").agg(F.count("*").alias("n"))


@query("v04_grid_coverage", sql("episodes", "SELECT s.sample_id, r AS repeat_id FROM (SELECT DISTINCT sample_id FROM episodes) s, (VALUES (0), (1)) t(r) WHERE NOT EXISTS (SELECT 1 FROM episodes e WHERE e.sample_id = s.sample_id AND e.repeat_id = r AND e.method = 'baseline' AND e.steps % 5 <> 0)"))
def v04(spark, sf):
    e = traces.episodes(spark, sf)
    return va.missing_from_grid(e.where("method = 'baseline' and steps % 5 <> 0"), e.select("sample_id").distinct(), (0, 1)).select("sample_id", "repeat_id")


@query("v05_unknown_ids", sql("episodes", "SELECT range AS sample_id FROM range(0, 400) WHERE range NOT IN (SELECT sample_id FROM episodes)"))
def v05(spark, sf):
    return va.dangling(spark.range(0, 400).withColumnRenamed("id", "sample_id"), traces.episodes(spark, sf), "sample_id", "sample_id")


@query("v06_partitioned_segments", "SELECT vec_id AS segment_id, CASE WHEN vec_id % 10 = 0 THEN 0 ELSE 2 END::BIGINT AS n FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 21 = 1")
def v06(spark, sf):
    n = traces.nodes(spark, sf).select("segment_id")
    members = n.where("segment_id % 10 <> 0").unionByName(n.where("segment_id % 21 = 1 and segment_id % 10 <> 0"))
    return va.not_partitioned(members, n).select("segment_id", "n")


@query("v07_referential_integrity", "SELECT 'order without customer' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0) UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 7)")
def v07(spark, sf):
    c = traces.read(spark, sf, "customer").where("c_custkey % 50 <> 0")
    o = traces.read(spark, sf, "orders")
    a = va.dangling(o.select("o_custkey"), c, "o_custkey", "c_custkey").agg(F.count("*").alias("n")).select(F.lit("order without customer").alias("rule"), "n")
    b = va.dangling(traces.read(spark, sf, "lineitem").select("l_orderkey"), o.where("o_orderkey % 100 <> 7"), "l_orderkey", "o_orderkey").agg(F.count("*").alias("n"))
    return a.unionByName(b.select(F.lit("line without order").alias("rule"), "n"))


@query("v08_policy_rules", sql("episodes", "p AS (SELECT 'high_' || (sample_id % 6) AS id, avg(success::INT) - 0.11 AS penalty FROM episodes GROUP BY 1) SELECT id FROM p WHERE NOT penalty > 0 OR NOT starts_with(id, 'high_')"))
def v08(spark, sf):
    p = traces.episodes(spark, sf).groupBy(F.concat(F.lit("high_"), F.col("sample_id") % 6).alias("id")).agg((F.avg(F.col("success").cast("int")) - 0.11).alias("penalty"))
    return va.violations(p, {"penalty": F.col("penalty") > 0, "prefix": F.col("id").startswith("high_")}).select("id").distinct()


@query("v09_library_coverage", "SELECT p_partkey AS skill_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def v09(spark, sf):
    cards = traces.read(spark, sf, "part").select(F.col("p_partkey").alias("skill_id"))
    return va.dangling(cards, traces.read(spark, sf, "lineitem").where("l_quantity > 45"), "skill_id", "l_partkey")


@query("v10_index_dimensions", "SELECT vec_id AS skill_id FROM embeddings WHERE vec_id % 40 = 3")
def v10(spark, sf):
    v = traces.read(spark, sf, "embeddings").select(F.col("vec_id").alias("skill_id"), F.when(F.col("vec_id") % 40 == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("vector"))
    return va.bad_dimensions(v, "skill_id", "vector")


@query("v11_configuration_rules", "SELECT * FROM (VALUES ('b', 'least above most'), ('c', 'ratio range')) t(name, rule)")
def v11(spark, sf):
    """Cross-field rules of a configuration, as rows."""
    c = spark.createDataFrame([("a", 2, 8, 0.5), ("b", 5, 3, 0.2), ("c", 1, 4, 1.5)], "name string, least int, most int, ratio double")
    return va.violations(c, {"least above most": F.col("least") <= F.col("most"), "ratio range": F.col("ratio").between(0, 1)}).select("name", "rule")


@query("v12_training_provenance", sql("episodes", "p AS (SELECT *, CASE WHEN sample_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM episodes), r AS (SELECT 'outside the train split' AS rule, trajectory_id FROM p WHERE split <> 'train' AND steps % 13 = 0 UNION ALL SELECT 'methods of the version', any_value(trajectory_id ORDER BY trajectory_id) FROM p GROUP BY sample_id, repeat_id HAVING count(DISTINCT method) <> 2) SELECT rule, count(*) AS n FROM r GROUP BY 1"))
def v12(spark, sf):
    """A training pool (here: episodes of the train split, and some that slipped in) may hold the train split alone; a version's
    repeat must hold exactly its two methods."""
    e = traces.episodes(spark, sf).withColumn("split", F.when(F.col("sample_id") % 10 < 8, "train").otherwise("test"))
    pool = e.where("split = 'train' or steps % 13 = 0")
    outside = va.violations(pool, {"outside the train split": F.col("split") == "train"}).select("rule")
    methods = va.wrong_set(e, ("sample_id", "repeat_id"), "method", ("baseline", "candidate")).select(F.lit("methods of the version").alias("rule"))
    return outside.unionByName(methods).groupBy("rule").agg(F.count("*").alias("n"))


@query("v13_disjoint_parts", sql("episodes", "p AS (SELECT sample_id, 'a' AS part FROM episodes WHERE sample_id % 2 = 0 UNION SELECT sample_id, 'b' FROM episodes WHERE sample_id % 3 = 0) SELECT sample_id, count(*) AS parts FROM p GROUP BY 1 HAVING count(*) > 1"))
def v13(spark, sf):
    e = traces.episodes(spark, sf).select("sample_id")
    return va.shared_ids(e.where("sample_id % 2 = 0").withColumn("part", F.lit("a")).unionByName(e.where("sample_id % 3 = 0").withColumn("part", F.lit("b"))), "sample_id", "part")


@query("v14_contract_equality", sql("episodes", "b AS (SELECT sample_id, repeat_id, steps, max_k, success FROM episodes WHERE method = 'baseline'), c AS (SELECT sample_id, repeat_id, steps, max_k, success FROM episodes WHERE method = 'candidate'), j AS (SELECT b.steps <> c.steps AS s, b.max_k <> c.max_k AS k, b.success <> c.success AS u FROM b JOIN c USING (sample_id, repeat_id)), r AS (SELECT 'steps' AS field FROM j WHERE s UNION ALL SELECT 'max_k' FROM j WHERE k UNION ALL SELECT 'success' FROM j WHERE u) SELECT field, count(*) AS n FROM r GROUP BY 1"))
def v14(spark, sf):
    """Fields in which an extending run differs from the run that it extends, key by key."""
    e = traces.episodes(spark, sf).select("sample_id", "repeat_id", "method", "steps", "max_k", "success")
    run = lambda m: e.where(F.col("method") == m).drop("method")
    return va.contract_breaks(run("baseline"), run("candidate"), ("sample_id", "repeat_id"), ("steps", "max_k", "success")).groupBy("field").agg(F.count("*").alias("n"))


@query("v15_context_within_selection", sql("steps", "SELECT trajectory_id FROM steps GROUP BY 1 HAVING bool_or(k % 5 = 0) AND NOT bool_or(k % 10 = 0)"))
def v15(spark, sf):
    s = traces.steps(spark, sf)
    context = s.where("k % 5 = 0").groupBy("trajectory_id").agg(F.collect_set(F.col("k") % 5).alias("context"))
    selection = s.where("k % 10 = 0").groupBy("trajectory_id").agg(F.collect_set(F.col("k") % 10).alias("selection"))
    j = context.join(selection, "trajectory_id", "left").withColumn("selection", F.coalesce("selection", F.array().cast("array<int>")))
    return j.where(F.size(F.array_except("context", "selection")) > 0).select("trajectory_id")


@query("v16_segment_inputs", sql("segments", "SELECT segment_id FROM segments WHERE n_steps > 4"))
def v16(spark, sf):
    return va.violations(sq.segments(traces.steps(spark, sf)), {"too long": F.col("n_steps") <= 4, "no label": F.col("event_type").isNotNull()}).select("segment_id")


@query("v17_selectors", "SELECT * FROM (VALUES ('a=/x', NULL), ('b=/y', NULL), (NULL, 0), (NULL, 2), (NULL, 3), (NULL, 4)) t(assignment, shard)")
def v17(spark, sf):
    from ..plans.selectors import assignments, shard_ids

    rows = [(f"{k}={v}", None) for k, v in assignments(["a=/x", "b=/y"]).items()] + [(None, i) for i in shard_ids("0,2-4", 10)]
    return spark.createDataFrame(rows, "assignment string, shard int")


@query("v18_digest_chain", sql("episodes", "d AS (SELECT trajectory_id, sha256(trajectory_id || chr(31) || steps::VARCHAR) AS d FROM episodes) SELECT sha256(string_agg(d, '' ORDER BY trajectory_id)) AS digest, count(*) AS n FROM d"))
def v18(spark, sf):
    return va.chained_digest(traces.episodes(spark, sf).select("trajectory_id", "steps"), "trajectory_id", "trajectory_id", "steps")


@query("v19_frozen_selection", sql("episodes", "SELECT left(sha256(string_agg(sample_id::VARCHAR, chr(31) ORDER BY sample_id)), 16) AS selection_id FROM (SELECT DISTINCT sample_id FROM episodes WHERE NOT success)"))
def v19(spark, sf):
    s = traces.episodes(spark, sf).where("not success").agg(F.array_sort(F.collect_set("sample_id")).alias("ids"))
    return s.select(F.substring(F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), "\x1f"), 256), 1, 16).alias("selection_id"))
