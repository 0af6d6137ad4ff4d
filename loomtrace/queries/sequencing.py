"""Window and sequence operators (W), sorts and top-k (T), joins (J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import traces
from ..operators import deployment as dp
from ..operators import evaluation as ev
from ..operators import labels as lb
from ..operators import manifests as mf
from ..operators import sequences as sq
from ..operators import validation as va
from ..oracle import sql
from .evaluating import _PAIRS, _bundled

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


@query("w01_runlength_segments", sql("segments", "SELECT segment_id, trajectory_id, start_step, end_step, event_type, n_steps FROM segments"))
def w01(spark, sf):
    return sq.segments(traces.steps(spark, sf)).select("segment_id", "trajectory_id", "start_step", "end_step", "event_type", "n_steps")


@query("w02_compressed_sequence", sql("steps", "x AS (SELECT *, lag(event_type) OVER (PARTITION BY trajectory_id ORDER BY step_index) AS p FROM steps) SELECT trajectory_id, string_agg(event_type, '>' ORDER BY step_index) AS seq FROM x WHERE p IS DISTINCT FROM event_type GROUP BY 1"))
def w02(spark, sf):
    return sq.sequences(traces.steps(spark, sf), order="step_index").select("trajectory_id", F.array_join("seq", ">").alias("seq"))


@query("w03_bigrams", sql("segments", "SELECT * FROM (SELECT trajectory_id, start_step, event_type AS source, lead(event_type) OVER (PARTITION BY trajectory_id ORDER BY start_step) AS target FROM segments) WHERE target IS NOT NULL"))
def w03(spark, sf):
    return sq.pairs(sq.segments(traces.steps(spark, sf)))


_NGRAMS = """g AS (SELECT DISTINCT trajectory_id, string_agg(event_type, '>' ORDER BY pos) AS path, count(DISTINCT event_type) AS kinds FROM (
  SELECT a.trajectory_id, a.pos AS start, n, b.pos, b.event_type FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY start_step) AS pos FROM segments) a, (VALUES (2), (3), (4)) t(n),
  (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY start_step) AS pos, count(*) OVER (PARTITION BY trajectory_id) AS total FROM segments) b WHERE b.trajectory_id = a.trajectory_id AND b.pos BETWEEN a.pos AND a.pos + n - 1 AND a.pos + n - 1 <= b.total)
  GROUP BY trajectory_id, start, n)"""


@query("w04_ngrams", sql("segments", f"{_NGRAMS} SELECT path, count(*) AS n FROM g WHERE kinds >= 2 GROUP BY 1"))
def w04(spark, sf):
    s = sq.sequences(sq.segments(traces.steps(spark, sf)))
    return s.select(F.explode(sq.ngrams(F.col("seq"), 4)).alias("p")).groupBy(F.array_join("p", ">").alias("path")).agg(F.count("*").alias("n"))


@query("w05_event_context", sql("segments", "SELECT segment_id, coalesce(lag(event_type) OVER w, 'START') AS previous_event, coalesce(lead(event_type) OVER w, 'END') AS next_event FROM segments WINDOW w AS (PARTITION BY trajectory_id ORDER BY start_step)"))
def w05(spark, sf):
    return sq.with_context(sq.segments(traces.steps(spark, sf))).select("segment_id", "previous_event", "next_event")


@query("w06_repeated_event", sql("segments", "SELECT segment_id, row_number() OVER (PARTITION BY trajectory_id, event_type ORDER BY start_step) > 1 AS repeated FROM segments"))
def w06(spark, sf):
    w = Window.partitionBy("trajectory_id", "event_type").orderBy("start_step")
    return sq.segments(traces.steps(spark, sf)).select("segment_id", (F.row_number().over(w) > 1).alias("repeated"))


@query("w08_path_anchor", sql("segments", "x AS (SELECT *, row_number() OVER w - 1 AS pos, lead(event_type) OVER w AS n FROM segments WINDOW w AS (PARTITION BY trajectory_id ORDER BY start_step)) SELECT trajectory_id, min(pos) FILTER (event_type = 'view' AND n = 'click')::INTEGER AS anchor FROM x GROUP BY 1"))
def w08(spark, sf):
    return sq.sequences(sq.segments(traces.steps(spark, sf))).select("trajectory_id", sq.anchor(F.col("seq"), F.array(F.lit("view"), F.lit("click"))).alias("anchor"))


@query("w09_first_completion", sql("steps", "r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, event_type ORDER BY event_id) AS rn, first_value(k) OVER (PARTITION BY sample_id, event_type ORDER BY event_id) AS first_k FROM steps) SELECT sample_id, event_type, min(first_k) AS kept_k, count(*) - 1 AS discarded, count(*) FILTER (k <> first_k) AS disagreeing FROM r GROUP BY 1, 2"))
def w09(spark, sf):
    w = Window.partitionBy("sample_id", "event_type").orderBy("event_id")
    r = traces.steps(spark, sf).withColumn("first_k", F.first("k").over(w))
    return r.groupBy("sample_id", "event_type").agg(F.min("first_k").alias("kept_k"), (F.count("*") - 1).alias("discarded"), F.count_if(F.col("k") != F.col("first_k")).alias("disagreeing"))


@query("w10_round_robin_shards", sql("episodes", "m AS (SELECT DISTINCT sample_id, repeat_id FROM episodes) SELECT sample_id, repeat_id, ((row_number() OVER (ORDER BY sample_id, repeat_id) - 1) % 10)::INTEGER AS shard FROM m"))
def w10(spark, sf):
    m = traces.episodes(spark, sf).select("sample_id", "repeat_id").distinct()
    return sq.shards(m, 10, "sample_id", "repeat_id")


@query("w11_run_concatenation", sql("segments", "x AS (SELECT trajectory_id, run, event_type, min(step_index) AS start_step, string_agg(k::VARCHAR, ',' ORDER BY step_index) AS actions FROM islands GROUP BY 1, 2, 3) SELECT trajectory_id, start_step, event_type, actions FROM x"))
def w11(spark, sf):
    actions = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_index", "k"))), lambda s: s["k"].cast("string")), ",").alias("actions")
    return sq.segments(traces.steps(spark, sf), actions).select("trajectory_id", "start_step", "event_type", "actions")


@query("w12_prefix_sums", sql("steps", "SELECT trajectory_id, step_index, sum(k) OVER w::BIGINT AS prefix, sum(k * k) OVER w::BIGINT AS prefix_squares FROM steps WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_index)"))
def w12(spark, sf):
    w = sq.by_step().rowsBetween(Window.unboundedPreceding, 0)
    return traces.steps(spark, sf).select("trajectory_id", "step_index", F.sum("k").over(w).alias("prefix"), F.sum(F.col("k") * F.col("k")).over(w).alias("prefix_squares"))


# ---- top-k


@query("t02_path_ranking", sql("segments", f"{_NGRAMS} SELECT path, n, row_number() OVER (ORDER BY n DESC, length(path), path) AS rank FROM (SELECT path, count(*) AS n FROM g WHERE kinds >= 2 GROUP BY 1) ORDER BY rank LIMIT 20"))
def t02(spark, sf):
    top = w04(spark, sf).orderBy(F.desc("n"), F.length("path"), "path").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.length("path"), "path")).cast("long"))


@query("t04_example_quota", sql("steps", """c AS (SELECT k % 10 AS cluster, event_type, count(*) AS n FROM steps GROUP BY 1, 2), q AS (SELECT *, 8.0 * n / sum(n) OVER (PARTITION BY cluster) AS exact FROM c),
  r AS (SELECT *, floor(exact) AS base, row_number() OVER (PARTITION BY cluster ORDER BY exact - floor(exact) DESC, event_type) AS rr FROM q), l AS (SELECT *, 8 - sum(base) OVER (PARTITION BY cluster) AS rest FROM r) SELECT cluster, event_type, (base + CASE WHEN rr <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM l"""))
def t04(spark, sf):
    c = traces.steps(spark, sf).groupBy((F.col("k") % 10).alias("cluster"), "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster")
    q = c.withColumn("exact", 8.0 * F.col("n") / F.sum("n").over(w)).withColumn("base", F.floor("exact"))
    r = q.withColumn("rr", F.row_number().over(w.orderBy(F.desc(F.col("exact") - F.col("base")), "event_type"))).withColumn("rest", 8 - F.sum("base").over(w))
    return r.select("cluster", "event_type", (F.col("base") + F.when(F.col("rr") <= F.col("rest"), 1).otherwise(0)).cast("long").alias("quota"))


@query("t05_representatives", sql("segments", "s AS (SELECT trajectory_id, string_agg(event_type, '>' ORDER BY start_step) AS seq FROM segments GROUP BY 1), d AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY trajectory_id) AS rn FROM s) SELECT trajectory_id, rank FROM (SELECT trajectory_id, row_number() OVER (ORDER BY rn > 1, trajectory_id) AS rank FROM d) WHERE rank <= 8"))
def t05(spark, sf):
    s = sq.sequences(sq.segments(traces.steps(spark, sf)))
    d = s.withColumn("again", F.row_number().over(Window.partitionBy("seq").orderBy("trajectory_id")) > 1).orderBy("again", "trajectory_id").limit(8)
    return d.select("trajectory_id", F.row_number().over(Window.orderBy("again", "trajectory_id")).cast("long").alias("rank"))


@query("t06_downweight_candidate", sql("episodes", f"{_PAIRS}, b AS (SELECT 'high_' || (sample_id % 6) AS bundle, count(*) AS exposure, avg(s2::INT) AS performance, avg(s2::INT - s1::INT) AS gain FROM pr GROUP BY 1) SELECT bundle, exposure, gain FROM b WHERE exposure >= 5 ORDER BY gain, performance, exposure DESC, bundle LIMIT 1"))
def t06(spark, sf):
    return dp.bundle_metrics(_bundled(spark, sf)).where("exposure >= 5").orderBy("gain", "performance", F.desc("exposure"), "bundle").limit(1).select("bundle", "exposure", "gain")


@query("t07_structural_choice", sql("episodes", "SELECT method AS action, trajectory_id FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY primary_score DESC, steps, trajectory_id) AS rn FROM episodes) WHERE rn = 1"))
def t07(spark, sf):
    w = Window.partitionBy("method").orderBy(F.desc("primary_score"), "steps", "trajectory_id")
    return traces.episodes(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("method").alias("action"), "trajectory_id")


@query("t08_gate_winner", sql("episodes", "s AS (SELECT sample_id, min(primary_score) AS low, count(*) AS n, sum(invalid_actions)::BIGINT AS actions FROM episodes GROUP BY 1) SELECT sample_id, low, actions FROM s ORDER BY low DESC, actions, sample_id LIMIT 1"))
def t08(spark, sf):
    s = traces.episodes(spark, sf).groupBy("sample_id").agg(F.min("primary_score").alias("low"), F.sum("invalid_actions").alias("actions"))
    return s.orderBy(F.desc("low"), "actions", "sample_id").limit(1)


@query("t09_cap_selection")
def t09(spark, sf):
    """Best cap by mean, then the smallest cap whose interval against the best holds zero."""
    e = traces.episodes(spark, sf).withColumn("cap", F.element_at(F.array(F.lit(3), F.lit(5), F.lit(8)), (F.col("steps") % 3 + 1).cast("int")))
    means = e.groupBy("cap").agg(F.avg("primary_score").alias("mean")).orderBy(F.desc("mean"), "cap")
    best = means.first()["cap"]  # three caps
    tasks = e.groupBy("sample_id").agg(*[F.avg(F.when(F.col("cap") == c, F.col("primary_score"))).alias(f"c{c}") for c in (3, 5, 8)])
    out = None
    for c in (3, 5, 8):
        d = tasks.select("sample_id", (F.col(f"c{c}") - F.col(f"c{best}")).alias("value")).where("value is not null")
        i = ev.interval(ev.bootstrap_means(d, samples=500, seed=42)).select(F.lit(c).alias("cap"), (F.col("ci_low") <= 0).alias("a"), (F.col("ci_high") >= 0).alias("b"))
        out = i if out is None else out.unionByName(i)
    return out.where("a and b").agg(F.min("cap").alias("selected_cap")).withColumn("best_cap", F.lit(best))


@query("t10_example_selection", sql("episodes", "SELECT trajectory_id FROM (SELECT trajectory_id, primary_score, row_number() OVER (PARTITION BY sample_id ORDER BY primary_score DESC, trajectory_id) AS rn FROM episodes) WHERE rn = 1 ORDER BY primary_score DESC, trajectory_id LIMIT 8"))
def t10(spark, sf):
    w = Window.partitionBy("sample_id").orderBy(F.desc("primary_score"), "trajectory_id")
    return traces.episodes(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn = 1").orderBy(F.desc("primary_score"), "trajectory_id").limit(8).select("trajectory_id")


# ---- joins


@query("j01_paired_comparison", sql("episodes", f"{_PAIRS} SELECT sample_id, repeat_id, p1 AS base_primary_score, p2 AS cand_primary_score FROM pr"))
def j01(spark, sf):
    """Of the repeats that both methods have run; the last four weeks may hold the baseline alone."""
    e = traces.episodes(spark, sf)
    run = e.groupBy("repeat_id").agg(F.count_distinct("method").alias("methods")).where("methods = 2")
    e = e.join(run.select("repeat_id"), "repeat_id", "left_semi")
    va.require_empty(ev.unpaired(e), "keys of the two methods differ")
    return ev.paired(e).select("sample_id", "repeat_id", "base_primary_score", "cand_primary_score")


@query("j02_feedback_pairs", sql("episodes", f"{_PAIRS} SELECT sample_id, repeat_id, 'high_' || (sample_id % 6) AS bundle, s1 AS base_success, s2 AS cand_success, n1 AS base_steps, n2 AS cand_steps FROM pr"))
def j02(spark, sf):
    return _bundled(spark, sf).select("sample_id", "repeat_id", "bundle", "base_success", "cand_success", "base_steps", "cand_steps")


@query("j03_result_mismatch", sql("episodes", "r AS (SELECT trajectory_id, CASE WHEN steps % 9 = 0 THEN steps + 1 ELSE steps END AS claimed FROM episodes) SELECT trajectory_id, claimed, steps FROM r JOIN episodes USING (trajectory_id) WHERE claimed <> steps"))
def j03(spark, sf):
    e = traces.episodes(spark, sf)
    r = e.select("trajectory_id", F.when(F.col("steps") % 9 == 0, F.col("steps") + 1).otherwise(F.col("steps")).alias("claimed"))
    return r.join(e, "trajectory_id").where("claimed <> steps").select("trajectory_id", "claimed", "steps")


@query("j04_missing_and_unexpected", sql("episodes", "SELECT 'missing' AS side, trajectory_id FROM episodes WHERE steps % 7 = 0 UNION ALL SELECT 'unexpected', 'x' || trajectory_id FROM episodes WHERE steps % 13 = 0"))
def j04(spark, sf):
    e = traces.episodes(spark, sf)
    want = e.select("trajectory_id")
    have = e.where("steps % 7 <> 0").select("trajectory_id").unionByName(e.where("steps % 13 = 0").select(F.concat(F.lit("x"), "trajectory_id").alias("trajectory_id")))
    missing, extra = want.join(have, "trajectory_id", "left_anti"), have.join(want, "trajectory_id", "left_anti")
    return missing.select(F.lit("missing").alias("side"), "trajectory_id").unionByName(extra.select(F.lit("unexpected").alias("side"), "trajectory_id"))


@query("j05_cluster_lookup", sql("segments", "SELECT segment_id, 'mid_' || list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS mid FROM segments"))
def j05(spark, sf):
    names = spark.createDataFrame([(e, f"mid_{i + 1}") for i, e in enumerate(("click", "error", "purchase", "signup", "view"))], "event_type string, mid string")
    s = sq.segments(traces.steps(spark, sf)).join(F.broadcast(names), "event_type", "left")  # five labels
    va.require_empty(s.where("mid is null").select("segment_id"), "segment without a cluster")
    return s.select("segment_id", "mid")


@query("j06_goal_lookup", sql("episodes goals", "SELECT trajectory_id, query, price_upper FROM episodes JOIN goals ON goal_index = sample_id"))
def j06(spark, sf):
    e = traces.episodes(spark, sf).withColumn("sample", F.concat(F.lit("shop:"), "sample_id"))
    key = F.element_at(F.split("sample", ":"), -1).cast("long")
    return e.withColumn("goal_index", key).join(traces.goals(spark, sf), "goal_index").select("trajectory_id", "query", "price_upper")


@query("j07_evidence_assembly", sql("segments commands", "SELECT s.event_type AS cluster, count(DISTINCT s.segment_id) AS n_segments, count(*) AS n_steps, left(sha256(string_agg(c.command, '|' ORDER BY c.trajectory_id, c.step_index)), 12) AS digest FROM segments s JOIN commands c ON c.trajectory_id = s.trajectory_id AND c.step_index BETWEEN s.start_step AND s.end_step GROUP BY 1"))
def j07(spark, sf):
    runs = sq.runs(traces.steps(spark, sf)).select("trajectory_id", "step_index", "run", F.col("event_type").alias("cluster"))
    j = runs.join(traces.commands(spark, sf).select("trajectory_id", "step_index", "command"), ["trajectory_id", "step_index"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trajectory_id", "step_index", "command"))), lambda s: s["command"]), "|")
    return j.groupBy("cluster").agg(F.count_distinct("trajectory_id", "run").alias("n_segments"), F.count("*").alias("n_steps"), F.substring(F.sha2(text, 256), 1, 12).alias("digest"))


@query("j08_samples_by_repeats", sql("episodes", "SELECT sample_id, r AS repeat_id FROM (SELECT DISTINCT sample_id FROM episodes), (VALUES (2), (0), (1)) t(r)"))
def j08(spark, sf):
    return mf.expand(traces.episodes(spark, sf).select("sample_id"), (2, 0, 1))


@query("j10_cluster_overlap", "WITH o AS (SELECT vec_id AS s, label AS a FROM embeddings), n AS (SELECT vec_id AS s, vec_id % 12 AS b FROM embeddings WHERE vec_id % 5 <> 0), x AS (SELECT a, b, count(*) AS shared FROM o JOIN n USING (s) GROUP BY 1, 2) SELECT a::BIGINT AS old_id, b AS new_id, shared, round(shared / (SELECT count(*) FROM o WHERE o.a = x.a), 6) AS retention, round(shared / (SELECT count(*) FROM n WHERE n.b = x.b), 6) AS purity FROM x WHERE shared / (SELECT count(*) FROM o WHERE o.a = x.a) >= 0.08 OR shared / (SELECT count(*) FROM n WHERE n.b = x.b) >= 0.12")
def j10(spark, sf):
    old, new = _partitions(spark, sf)
    o = dp.overlaps(old, new, least_retention=0.08, least_purity=0.12)
    return o.select("old_id", "new_id", "shared", F.round("retention", 6).alias("retention"), F.round("purity", 6).alias("purity"))


def _partitions(spark, sf):
    v = traces.read(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("segment_id"), F.col("label").cast("long").alias("old_id")), v.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("segment_id"), (F.col("vec_id") % 12).alias("new_id"))


@query("j12_four_way_alignment", sql("episodes", "SELECT a.sample_id, round((d.primary_score - c.primary_score) - (b.primary_score - a.primary_score), 6) AS did FROM episodes a JOIN episodes b USING (sample_id) JOIN episodes c USING (sample_id) JOIN episodes d USING (sample_id) WHERE a.method = 'baseline' AND a.repeat_id = 0 AND b.method = 'candidate' AND b.repeat_id = 0 AND c.method = 'baseline' AND c.repeat_id = 1 AND d.method = 'candidate' AND d.repeat_id = 1"))
def j12(spark, sf):
    e = traces.episodes(spark, sf)
    side = lambda m, r, n: e.where((F.col("method") == m) & (F.col("repeat_id") == r)).select("sample_id", F.col("primary_score").alias(n))
    j = side("baseline", 0, "a").join(side("candidate", 0, "b"), "sample_id").join(side("baseline", 1, "c"), "sample_id").join(side("candidate", 1, "d"), "sample_id")
    return j.select("sample_id", F.round((F.col("d") - F.col("c")) - (F.col("b") - F.col("a")), 6).alias("did"))


@query("j13_failure_candidates", sql("episodes", "f AS (SELECT * FROM episodes WHERE NOT success), s AS (SELECT DISTINCT sample_id, sample_id % 5 AS goal FROM episodes WHERE success AND sample_id % 4 = 0) SELECT trajectory_id, bool_or(f.sample_id IN (SELECT sample_id FROM s)) AS same_sample FROM f WHERE f.sample_id IN (SELECT sample_id FROM s) OR f.sample_id % 5 IN (SELECT goal FROM s WHERE sample_id % 20 = 0) GROUP BY 1"))
def j13(spark, sf):
    e = traces.episodes(spark, sf)
    s = e.where("success and sample_id % 4 = 0").select("sample_id").distinct()
    f = e.where("not success").withColumn("goal", F.col("sample_id") % 5)
    by_sample = f.join(s, "sample_id", "left_semi").withColumn("same_sample", F.lit(True))
    goals = s.where("sample_id % 20 = 0").select((F.col("sample_id") % 5).alias("goal"))
    by_goal = f.join(goals, "goal", "left_semi").withColumn("same_sample", F.lit(False))
    return by_sample.unionByName(by_goal).groupBy("trajectory_id").agg(F.bool_or("same_sample").alias("same_sample"))


@query("j14_selected_results", sql("episodes", "SELECT trajectory_id FROM episodes WHERE (sample_id, repeat_id) IN (SELECT sample_id, repeat_id FROM episodes WHERE method = 'candidate' AND success)"))
def j14(spark, sf):
    e = traces.episodes(spark, sf)
    return e.join(e.where("method = 'candidate' and success").select("sample_id", "repeat_id"), ["sample_id", "repeat_id"], "left_semi").select("trajectory_id")


@query("j15_optional_estimate", sql("episodes", f"{_PAIRS}, b AS (SELECT 'high_' || (sample_id % 6) AS bundle, count(*) AS exposure FROM pr GROUP BY 1) SELECT bundle, exposure, CASE WHEN bundle <> 'high_3' THEN exposure / 2 END AS estimate FROM b"))
def j15(spark, sf):
    m = dp.bundle_metrics(_bundled(spark, sf)).select("bundle", "exposure")
    return m.join(m.where("bundle <> 'high_3'").select("bundle", (F.col("exposure") / 2).alias("estimate")), "bundle", "left")


@query("j16_subset_pools", sql("episodes", "SELECT 0::BIGINT AS not_identical"))
def j16(spark, sf):
    e = traces.episodes(spark, sf)
    small = e.where("sample_id % 2 = 0")
    return small.exceptAll(e).agg(F.count("*").alias("not_identical"))


def _decisions(spark, sf):
    return lb.decisions(traces.shop(spark, sf), traces.goals(spark, sf))


@query("j09_similar_nodes", sql("branches", "SELECT source, target, percent FROM pct WHERE same_event AND percent >= 75 AND source <> target"))
def j09(spark, sf):
    """Directed pairs of decision nodes of one event whose matching percent is at least 75. The few hundred keys are a small table; still the pairing is an equi-join on the event."""
    from ..operators.policies import nodes_of, similar

    return similar(nodes_of(_decisions(spark, sf))).select("source", "target", "percent")


