"""Aggregations (A), set operations (U) and statistics (Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import traces
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import evaluation as ev
from ..operators import labels as lb
from ..operators import sequences as sq
from ..oracle import sql
from .labelling import _PRIMITIVE

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


_PAIRS = "pr AS (SELECT a.sample_id, a.repeat_id, a.success AS s1, b.success AS s2, a.steps AS n1, b.steps AS n2, a.primary_score AS p1, b.primary_score AS p2, a.billable_tokens AS t1, b.billable_tokens AS t2 FROM episodes a JOIN episodes b USING (sample_id, repeat_id) WHERE a.method = 'baseline' AND b.method = 'candidate')"
_SAVE = "CASE WHEN s2 < s1 THEN least((n1 - n2) / greatest(n1, 1), 0) ELSE (n1 - n2) / greatest(n1, 1) END"


@query("a01_method_summary", sql("episodes", """SELECT method, count(*) AS n_episodes, count(DISTINCT sample_id) AS n_samples, round(avg(primary_score), 6) AS mean_score, avg(success::INT) AS success_rate, avg(steps) AS mean_steps,
  sum(invalid_actions) / greatest(sum(steps), 1) AS invalid_rate, avg(steps) FILTER (success) AS mean_steps_of_success, count(billable_tokens) / count(*) AS billable_tokens_coverage, coalesce(sum(billable_tokens), 0)::BIGINT AS billable_tokens_sum, avg(billable_tokens) AS billable_tokens_mean FROM episodes GROUP BY 1"""))
def a01(spark, sf):
    return ev.method_summary(traces.episodes(spark, sf))


@query("a02_usage_summary", sql("episodes", "SELECT repeat_id, count(billable_tokens) / count(*) AS billable_tokens_coverage, coalesce(sum(billable_tokens), 0)::BIGINT AS billable_tokens_sum, avg(billable_tokens) AS billable_tokens_mean FROM episodes GROUP BY 1"))
def a02(spark, sf):
    return traces.episodes(spark, sf).groupBy("repeat_id").agg(*ev.usage("billable_tokens"))


@query("a03_paired_optional_difference", sql("episodes", f"{_PAIRS} SELECT count(t2 - t1) / count(*) AS coverage, avg(t2 - t1) AS mean_difference FROM pr"))
def a03(spark, sf):
    d = F.col("cand_billable_tokens") - F.col("base_billable_tokens")
    return ev.paired(traces.episodes(spark, sf)).agg((F.count(d) / F.count("*")).alias("coverage"), F.avg(d).alias("mean_difference"))


@query("a04_two_level_mean", sql("episodes", "SELECT method, round(avg(m), 6) AS task_mean, count(*) AS n_tasks FROM (SELECT method, sample_id, avg(primary_score) AS m FROM episodes GROUP BY 1, 2) GROUP BY 1"))
def a04(spark, sf):
    return ev.task_means(traces.episodes(spark, sf), F.col("primary_score"))


@query("a05_result_audit", sql("episodes", """r AS (SELECT sample_id, repeat_id, method FROM episodes WHERE steps % 7 <> 0 UNION ALL SELECT sample_id, repeat_id, method FROM episodes WHERE steps % 11 = 0)
  SELECT (SELECT count(*) FROM r) AS n_results, (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY sample_id, repeat_id, method HAVING count(*) > 1)) AS n_duplicate_keys,
  (SELECT count(*) FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.sample_id = e.sample_id AND r.repeat_id = e.repeat_id AND r.method = e.method)) AS n_missing"""))
def a05(spark, sf):
    e = traces.episodes(spark, sf)
    key = ["sample_id", "repeat_id", "method"]
    r = e.where("steps % 7 <> 0").select(*key).unionByName(e.where("steps % 11 = 0").select(*key))
    counted = r.groupBy(*key).agg(F.count("*").alias("n"))
    missing = e.select(*key).join(counted, key, "left_anti").agg(F.count("*").alias("n_missing"))
    return counted.agg(F.sum("n").alias("n_results"), F.count_if(F.col("n") > 1).alias("n_duplicate_keys")).crossJoin(missing)  # one row each


@query("a06_unresolved_failures", sql("steps", """e AS (SELECT sample_id, repeat_id, step_index, 'error ' || k AS message, event_id AS ordinal FROM steps WHERE event_type = 'error'),
  done AS (SELECT DISTINCT sample_id, repeat_id FROM steps WHERE event_type = 'purchase' AND k > 60) SELECT sample_id, repeat_id, arg_max(message, ordinal) AS last_message, count(*) AS attempts FROM e WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.sample_id = e.sample_id AND d.repeat_id = e.repeat_id) GROUP BY 1, 2"""))
def a06(spark, sf):
    s = traces.steps(spark, sf)
    done = s.where("event_type = 'purchase' and k > 60").select(*ev.KEY).distinct()
    errors = s.where("event_type = 'error'").join(done, list(ev.KEY), "left_anti")
    return errors.groupBy(*ev.KEY).agg(F.max_by(F.concat(F.lit("error "), "k"), "event_id").alias("last_message"), F.count("*").alias("attempts"))


@query("a07_bundle_metrics", sql("episodes", f"{_PAIRS} SELECT 'high_' || (sample_id % 6) AS bundle, count(*) AS exposure, avg(s2::INT) AS performance, avg(s2::INT - s1::INT) AS gain, round(avg({_SAVE}), 6) AS saving FROM pr GROUP BY 1"))
def a07(spark, sf):
    from ..operators.deployment import bundle_metrics

    return bundle_metrics(_bundled(spark, sf)).withColumn("saving", F.round("saving", 6))


def _bundled(spark, sf):
    return ev.paired(traces.episodes(spark, sf)).withColumn("bundle", F.concat(F.lit("high_"), F.col("sample_id") % 6))


@query("a08_feedback_summary", sql("episodes", f"{_PAIRS} SELECT count(*) AS n, avg(s1::INT) AS base_rate, avg(s2::INT) AS cand_rate, count(*) FILTER (s2 > s1) AS wins, count(*) FILTER (s2 < s1) AS losses, count(*) FILTER (s2 = s1) AS ties, avg(n1) AS base_steps, avg(n2) AS cand_steps, round(avg({_SAVE}), 6) AS saving FROM pr"))
def a08(spark, sf):
    b, c = F.col("base_success").cast("int"), F.col("cand_success").cast("int")
    return ev.paired(traces.episodes(spark, sf)).agg(
        F.count("*").alias("n"), F.avg(b).alias("base_rate"), F.avg(c).alias("cand_rate"), F.count_if(c > b).alias("wins"), F.count_if(c < b).alias("losses"), F.count_if(c == b).alias("ties"),
        F.avg("base_steps").alias("base_steps"), F.avg("cand_steps").alias("cand_steps"), F.round(F.avg(ev.guarded_saving()), 6).alias("saving"),
    )


@query("a09_trajectory_quality", sql("steps", """x AS (SELECT *, event_type = lag(event_type) OVER w AS rep, k <> lag(k) OVER w AS chg FROM steps WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_index)),
  t AS (SELECT trajectory_id, count(*) AS n, coalesce(sum(rep::INT), 0) / greatest(count(*) - 1, 1) AS rr, coalesce(sum(chg::INT), 0) / greatest(count(*), 1) AS cr, max(event_type = 'purchase') AS bought FROM x GROUP BY 1)
  SELECT count(*) AS n_trajectories, avg(n) AS mean_steps, min(n) AS min_steps, max(n) AS max_steps, round(avg(rr), 6) AS repeated_rate, round(avg(cr), 6) AS changed_rate, count(*) FILTER (bought) AS n_bought, quantile_cont(n, 0.5) AS median_steps FROM t"""))
def a09(spark, sf):
    return _rates(spark, sf).agg(
        F.count("*").alias("n_trajectories"), F.avg("n").alias("mean_steps"), F.min("n").alias("min_steps"), F.max("n").alias("max_steps"), F.round(F.avg("repeated"), 6).alias("repeated_rate"), F.round(F.avg("changed"), 6).alias("changed_rate"),
        F.count_if("bought").alias("n_bought"), F.percentile("n", 0.5).alias("median_steps"),
    )


def _rates(spark, sf):
    w = sq.by_step()
    x = traces.steps(spark, sf).withColumn("rep", F.col("event_type") == F.lag("event_type").over(w)).withColumn("chg", F.col("k") != F.lag("k").over(w))
    n = F.count("*")
    return x.groupBy("trajectory_id").agg(n.alias("n"), (F.count_if("rep") / F.greatest(n - 1, F.lit(1))).alias("repeated"), (F.count_if("chg") / F.greatest(n, F.lit(1))).alias("changed"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))


@query("w07_repeat_and_change_rates", sql("steps", """x AS (SELECT *, event_type = lag(event_type) OVER w AS rep, k <> lag(k) OVER w AS chg FROM steps WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_index))
  SELECT trajectory_id, coalesce(sum(rep::INT), 0) / greatest(count(*) - 1, 1) AS repeated, coalesce(sum(chg::INT), 0) / greatest(count(*), 1) AS changed FROM x GROUP BY 1"""))
def w07(spark, sf):
    return _rates(spark, sf).select("trajectory_id", "repeated", "changed")


@query("a12_frequencies", sql("steps segments", """SELECT 'event' AS kind, event_type AS value, count(*) AS n FROM steps GROUP BY 2 UNION ALL SELECT 'segment_length', n_steps::VARCHAR, count(*) FROM segments GROUP BY 2"""))
def a12(spark, sf):
    s = traces.steps(spark, sf)
    events = s.groupBy(F.lit("event").alias("kind"), F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    lengths = sq.segments(s).groupBy(F.lit("segment_length").alias("kind"), F.col("n_steps").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return events.unionByName(lengths)


@query("a18_pool_audit", sql("episodes", """SELECT method, round(avg(primary_score), 6) AS mean_score, count(*) FILTER (primary_score >= 0.999) AS full_score, count(*) FILTER (primary_score > 0 AND primary_score < 0.999) AS partial_score, count(*) FILTER (primary_score = 0) AS zero_score,
  count(DISTINCT sample_id) * 2 = count(*) AS covers_grid FROM episodes GROUP BY 1"""))
def a18(spark, sf):
    p = F.col("primary_score")
    return traces.episodes(spark, sf).groupBy("method").agg(F.round(F.avg(p), 6).alias("mean_score"), F.count_if(p >= 0.999).alias("full_score"), F.count_if((p > 0) & (p < 0.999)).alias("partial_score"), F.count_if(p == 0).alias("zero_score"), (F.count_distinct("sample_id") * 2 == F.count("*")).alias("covers_grid"))


@query("a19_token_ratios", sql("episodes", "SELECT sum(input_tokens) FILTER (method = 'candidate')::BIGINT AS candidate_tokens, sum(input_tokens) FILTER (method = 'baseline')::BIGINT AS baseline_tokens, round(sum(input_tokens) FILTER (method = 'candidate') / sum(input_tokens) FILTER (method = 'baseline'), 6) AS ratio FROM episodes"))
def a19(spark, sf):
    total = lambda m: F.sum(F.when(F.col("method") == m, F.col("input_tokens")))
    return traces.episodes(spark, sf).agg(total("candidate").alias("candidate_tokens"), total("baseline").alias("baseline_tokens"), F.round(total("candidate") / total("baseline"), 6).alias("ratio"))


@query("a20_retrieval_audit", sql("steps", "SELECT event_type, count(*) AS n, avg(k % 5) AS mean_context, max(k % 5) AS max_context, count(*) FILTER (k % 2 = 0) AS n_high, count(*) FILTER (k % 2 = 1) AS n_mid FROM steps GROUP BY 1"))
def a20(spark, sf):
    s = traces.steps(spark, sf).withColumn("kind", F.when(F.col("k") % 2 == 0, "n_high").otherwise("n_mid"))
    base = s.groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.col("k") % 5).alias("mean_context"), F.max(F.col("k") % 5).alias("max_context"))
    return base.join(s.groupBy("event_type").pivot("kind", ["n_high", "n_mid"]).count().na.fill(0), "event_type")


@query("a21_behaviour", sql("shop", """q AS (SELECT trajectory_id, row_number() OVER (PARTITION BY trajectory_id, trim(lower(keywords)) ORDER BY step_index) AS r FROM shop WHERE keywords IS NOT NULL),
  s AS (SELECT trajectory_id, count(*) AS searches, count(*) FILTER (r > 1) AS repeated FROM q GROUP BY 1), t AS (SELECT trajectory_id, count(*) AS n FROM shop GROUP BY 1)
  SELECT count(*) AS n, sum(coalesce(searches, 0))::BIGINT AS searches, sum(coalesce(repeated, 0))::BIGINT AS repeated_searches, count(*) FILTER (n >= 20) AS long_runs FROM t LEFT JOIN s USING (trajectory_id)"""))
def a21(spark, sf):
    s = traces.shop(spark, sf)
    w = Window.partitionBy("trajectory_id", tx.normalise(F.col("keywords"))).orderBy("step_index")
    flagged = s.withColumn("again", F.col("keywords").isNotNull() & (F.row_number().over(w) > 1))
    t = flagged.groupBy("trajectory_id").agg(F.count("*").alias("n"), F.count("keywords").alias("s"), F.count_if("again").alias("r"))
    return t.agg(F.count("*").alias("n"), F.sum("s").alias("searches"), F.sum("r").alias("repeated_searches"), F.count_if(F.col("n") >= 20).alias("long_runs"))


@query("a23_run_summary", sql("episodes", "SELECT method, repeat_id, count(*) AS n, count(*) FILTER (success) AS n_success, avg(steps) FILTER (success) AS mean_success_steps, max(steps) AS max_steps FROM episodes GROUP BY 1, 2"))
def a23(spark, sf):
    return traces.episodes(spark, sf).groupBy("method", "repeat_id").agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"), F.avg(F.when(F.col("success"), F.col("steps"))).alias("mean_success_steps"), F.max("steps").alias("max_steps"))


@query("a24_win_tie_loss", sql("episodes", f"{_PAIRS} SELECT repeat_id, count(*) FILTER (p2 > p1) AS wins, count(*) FILTER (p2 = p1) AS ties, count(*) FILTER (p2 < p1) AS losses, round(avg(p2 - p1), 6) AS mean_delta FROM pr GROUP BY 1"))
def a24(spark, sf):
    d = F.col("cand_primary_score") - F.col("base_primary_score")
    return ev.paired(traces.episodes(spark, sf)).groupBy("repeat_id").agg(F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.round(F.avg(d), 6).alias("mean_delta"))


@query("a25_roles_by_signal", sql("steps", "SELECT k % 10 AS cluster, arg_max(event_type, (n * 1000 - ord)) AS role, max(n)::BIGINT AS support FROM (SELECT k, event_type, ord, sum(n) OVER (PARTITION BY k % 10, event_type) AS n FROM (SELECT k, event_type, count(*) AS n, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS ord FROM steps GROUP BY 1, 2)) GROUP BY 1"))
def a25(spark, sf):
    counts = traces.steps(spark, sf).groupBy((F.col("k") % 10).alias("cluster"), "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("cluster").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("role"), F.max("n").alias("support"))


@query("a26_cluster_profile", sql("steps", "SELECT k % 10 AS cluster, count(*) AS support, round(avg(round(reward * 100)::BIGINT) / 100, 4) AS mean_score, avg((event_type = 'purchase')::INT) AS full_ratio, count(DISTINCT trajectory_id) AS n_trajectories, left(min(trajectory_id || ' ' || event_type), 1200) AS example FROM steps GROUP BY 1"))
def a26(spark, sf):
    return traces.steps(spark, sf).groupBy((F.col("k") % 10).alias("cluster")).agg(
        F.count("*").alias("support"), F.round(F.avg(F.round(F.col("reward") * 100).cast("long")) / 100, 4).alias("mean_score"), F.avg((F.col("event_type") == "purchase").cast("int")).alias("full_ratio"), F.count_distinct("trajectory_id").alias("n_trajectories"), F.substring(F.min(F.concat_ws(" ", "trajectory_id", "event_type")), 1, 1200).alias("example"),
    )


@query("a27_condition_summary", sql("episodes", "SELECT method, count(*) AS n_tasks, round(avg(m), 6) AS mean_of_tasks, sum(lim)::BIGINT AS limit_reached FROM (SELECT method, sample_id, avg(primary_score) AS m, count(*) FILTER (steps >= 20) AS lim FROM episodes GROUP BY 1, 2 HAVING count(*) = 2) GROUP BY 1"))
def a27(spark, sf):
    tasks = traces.episodes(spark, sf).groupBy("method", "sample_id").agg(F.avg("primary_score").alias("m"), F.count_if(F.col("steps") >= 20).alias("lim"), F.count("*").alias("c")).where("c = 2")
    return tasks.groupBy("method").agg(F.count("*").alias("n_tasks"), F.round(F.avg("m"), 6).alias("mean_of_tasks"), F.sum("lim").alias("limit_reached"))


@query("a28_shard_completeness", sql("episodes", "m AS (SELECT sample_id, repeat_id, method, ((row_number() OVER (PARTITION BY method ORDER BY sample_id, repeat_id) - 1) % 10)::INTEGER AS shard, steps % 7 <> 0 AS done FROM episodes) SELECT method, shard, count(*) AS expected, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done) AS missing FROM m GROUP BY 1, 2"))
def a28(spark, sf):
    w = Window.partitionBy("method").orderBy("sample_id", "repeat_id")
    m = traces.episodes(spark, sf).withColumn("shard", (F.row_number().over(w) - 1) % 10).withColumn("done", F.col("steps") % 7 != 0)
    return m.groupBy("method", "shard").agg(F.count("*").alias("expected"), F.count_if("done").alias("completed"), F.count_if(~F.col("done")).alias("missing"))


@query("a22_transition_contrast", sql("segments episodes", "t AS (SELECT trajectory_id, event_type AS source, lead(event_type) OVER (PARTITION BY trajectory_id ORDER BY start_step) AS target FROM segments) SELECT source, target, count(*) FILTER (primary_score >= 0.5) AS success_count, count(*) FILTER (primary_score < 0.5) AS failure_count FROM t JOIN episodes USING (trajectory_id) WHERE target IS NOT NULL GROUP BY 1, 2"))
def a22(spark, sf):
    p = sq.pairs(sq.segments(traces.steps(spark, sf))).join(traces.episodes(spark, sf).select("trajectory_id", "primary_score"), "trajectory_id")
    return p.groupBy("source", "target").agg(F.count_if(F.col("primary_score") >= 0.5).alias("success_count"), F.count_if(F.col("primary_score") < 0.5).alias("failure_count"))


@query("a11_transition_strength", sql("segments", "t AS (SELECT trajectory_id, event_type AS source, lead(event_type) OVER (PARTITION BY trajectory_id ORDER BY start_step) AS target FROM segments), c AS (SELECT source, target, count(*) AS support FROM t WHERE target IS NOT NULL GROUP BY 1, 2) SELECT source, target, support, support / sum(support) OVER (PARTITION BY source) AS strength FROM c"))
def a11(spark, sf):
    from ..operators.graphs import transition_strength

    return transition_strength(sq.pairs(sq.segments(traces.steps(spark, sf))))


@query("a13_sample_support", sql("steps episodes", "SELECT event_type, count(DISTINCT sample_id) FILTER (primary_score >= 0.5) AS positive, count(DISTINCT sample_id) FILTER (primary_score < 0.5) AS negative FROM (SELECT s.event_type, s.sample_id, e.primary_score FROM steps s JOIN episodes e USING (trajectory_id)) GROUP BY 1"))
def a13(spark, sf):
    e = traces.episodes(spark, sf).select("trajectory_id", "primary_score")
    j = traces.steps(spark, sf).join(e, "trajectory_id")
    return j.groupBy("event_type").agg(F.count_distinct(F.when(F.col("primary_score") >= 0.5, F.col("sample_id"))).alias("positive"), F.count_distinct(F.when(F.col("primary_score") < 0.5, F.col("sample_id"))).alias("negative"))


@query("a15_cluster_purity", "WITH c AS (SELECT vec_id % 7 AS cluster, label, count(*) AS n FROM embeddings GROUP BY 1, 2), p AS (SELECT cluster, max(n) / sum(n) AS purity, sum(n)::BIGINT AS size FROM c GROUP BY 1) SELECT cluster, round(purity, 6) AS purity, size, round(sum(purity * size) OVER () / sum(size) OVER (), 6) AS weighted FROM p")
def a15(spark, sf):
    from ..operators.deployment import purity

    p = purity(traces.read(spark, sf, "embeddings").withColumn("cluster", F.col("vec_id") % 7), "cluster", "label")
    total = p.agg((F.sum(F.col("purity") * F.col("size")) / F.sum("size")).alias("weighted"))
    return p.crossJoin(total).select("cluster", F.round("purity", 6).alias("purity"), "size", F.round("weighted", 6).alias("weighted"))  # one total row


_CENTROID = "c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)"


@query("a16_compactness", f"WITH {_CENTROID} SELECT label, round(avg(list_sum(list_transform(list_zip(embedding::DOUBLE[], centroid), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(centroid, lambda x: x * x))))), 6) AS compactness FROM embeddings JOIN c USING (label) GROUP BY 1")
def a16(spark, sf):
    from ..operators.deployment import centroids

    v = traces.read(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    j = v.join(F.broadcast(centroids(v, "label", "v")), "label")  # ten labels
    return j.groupBy("label").agg(F.round(F.avg(vx.cosine(F.col("v"), F.col("centroid"), 0.0)), 6).alias("compactness"))


@query("a17_weighted_centroid", "SELECT label, i::INTEGER AS dim, round(sum((1 + vec_id % 3) * embedding[i + 1]::DOUBLE) / sum(1 + vec_id % 3), 6) AS value FROM embeddings, range(0, 64) t(i) GROUP BY 1, 2")
def a17(spark, sf):
    from ..operators.deployment import centroids

    v = traces.read(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"), (1 + F.col("vec_id") % 3).alias("w"))
    return centroids(v, "label", "v", "w").select("label", F.posexplode("centroid").alias("dim", "value")).select("label", "dim", F.round("value", 6).alias("value"))


# ---- set operations


@query("u01_pool_union", sql("episodes", "SELECT trajectory_id, method, steps FROM episodes"))
def u01(spark, sf):
    from ..operators.validation import require_empty, duplicates

    e = traces.episodes(spark, sf).select("trajectory_id", "method", "steps")
    both = e.where("method = 'baseline'").unionByName(e.where("method = 'candidate'"))
    require_empty(duplicates(both, "trajectory_id"), "duplicate trajectory")
    return both


@query("u02_key_differences", sql("episodes", "SELECT 'only_baseline' AS side, count(*) AS n FROM (SELECT sample_id FROM episodes WHERE method = 'baseline' AND success EXCEPT SELECT sample_id FROM episodes WHERE method = 'candidate' AND success) UNION ALL SELECT 'only_candidate', count(*) FROM (SELECT sample_id FROM episodes WHERE method = 'candidate' AND success EXCEPT SELECT sample_id FROM episodes WHERE method = 'baseline' AND success) UNION ALL SELECT 'both', count(*) FROM (SELECT sample_id FROM episodes WHERE method = 'candidate' AND success INTERSECT SELECT sample_id FROM episodes WHERE method = 'baseline' AND success)"))
def u02(spark, sf):
    e = traces.episodes(spark, sf).where("success")
    a, b = e.where("method = 'baseline'").select("sample_id"), e.where("method = 'candidate'").select("sample_id")
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count("only_baseline", a.subtract(b)).unionByName(count("only_candidate", b.subtract(a))).unionByName(count("both", a.intersect(b)))


@query("u03_overlap_report", sql("episodes", "f AS (SELECT sample_id, bool_or(NOT success AND method = 'baseline') AS a, bool_or(NOT success AND method = 'candidate') AS b FROM episodes WHERE repeat_id = 0 GROUP BY 1) SELECT count(*) FILTER (a) AS left_count, count(*) FILTER (b) AS right_count, count(*) FILTER (a AND b) AS common, round(coalesce(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a OR b), 0), 1), 6) AS jaccard FROM f"))
def u03(spark, sf):
    f = _failures(spark, sf)
    both, either = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))
    return f.agg(F.count_if("a").alias("left_count"), F.count_if("b").alias("right_count"), both.alias("common"), F.round(F.coalesce(F.try_divide(both, either), F.lit(1.0)), 6).alias("jaccard"))


def _failures(spark, sf):
    e = traces.episodes(spark, sf).where("repeat_id = 0 and not success")
    a, b = e.where("method = 'baseline'").select("sample_id", F.lit(True).alias("a")), e.where("method = 'candidate'").select("sample_id", F.lit(True).alias("b"))
    return a.join(b, "sample_id", "full_outer").select("sample_id", F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))


@query("u04_failure_categories", sql("episodes", "f AS (SELECT sample_id, bool_or(NOT success AND method = 'baseline') AS a, bool_or(NOT success AND method = 'candidate') AS b FROM episodes WHERE repeat_id = 0 GROUP BY 1) SELECT sample_id, CASE WHEN a AND b THEN 'common' WHEN a THEN 'left_only' ELSE 'right_only' END AS category FROM f WHERE a OR b"))
def u04(spark, sf):
    return _failures(spark, sf).select("sample_id", F.when(F.col("a") & F.col("b"), "common").when(F.col("a"), "left_only").otherwise("right_only").alias("category"))


@query("u05_ordered_union", sql("steps", "x AS (SELECT trajectory_id, k % 5 AS v, min(step_index) AS first FROM steps GROUP BY 1, 2) SELECT trajectory_id, string_agg(v::VARCHAR, ',' ORDER BY first) AS ids FROM x GROUP BY 1"))
def u05(spark, sf):
    s = traces.steps(spark, sf).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_index", (F.col("k") % 5).alias("v")))).alias("s"))
    half = F.floor(F.size("s") / 2).cast("int")
    first, second = F.slice("s", 1, F.greatest(half, F.lit(1))), F.slice("s", F.greatest(half, F.lit(1)) + 1, F.size("s"))
    ids = F.array_distinct(F.concat(F.transform(first, lambda x: x["v"]), F.transform(second, lambda x: x["v"])))
    return s.select("trajectory_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("u06_exclusion_candidates", sql("episodes", "SELECT DISTINCT sample_id FROM episodes WHERE sample_id NOT IN (SELECT sample_id FROM episodes WHERE success AND method = 'baseline') AND sample_id NOT IN (SELECT sample_id FROM episodes WHERE steps > 24)"))
def u06(spark, sf):
    e = traces.episodes(spark, sf)
    excluded = e.where("success and method = 'baseline'").select("sample_id").unionByName(e.where("steps > 24").select("sample_id"))
    return e.select("sample_id").distinct().join(excluded, "sample_id", "left_anti")


@query("u07_nested_pools")
def u07(spark, sf):
    """Pools of 25, 50 and 100 samples in one random order, so each lies in the next; the order hashes ids, not driver state."""
    s = traces.episodes(spark, sf).select("sample_id").distinct()
    rank = F.row_number().over(Window.orderBy(F.xxhash64("sample_id", F.lit(20260715)), "sample_id"))
    return s.withColumn("rank", rank).where("rank <= 100").select("sample_id", (F.col("rank") <= 25).alias("in_p25"), (F.col("rank") <= 50).alias("in_p50"), F.lit(True).alias("in_p100"))


@query("u08_seeded_selections")
def u08(spark, sf):
    """Selections of ten samples for several seeds without replacement between them."""
    from ..operators.manifests import selections

    return selections(traces.episodes(spark, sf).select("sample_id").distinct(), seeds=(1, 2, 3), size=10)


# ---- statistics


@query("q01_paired_bootstrap")
def q01(spark, sf):
    """Task-clustered paired bootstrap of the score difference."""
    d = ev.paired(traces.episodes(spark, sf)).groupBy("sample_id").agg(F.avg(F.col("cand_primary_score") - F.col("base_primary_score")).alias("value"))
    return ev.interval(ev.bootstrap_means(d, samples=2000, seed=42))


@query("q02_bootstrap_variants")
def q02(spark, sf):
    d = ev.paired(traces.episodes(spark, sf)).groupBy("sample_id").agg(F.avg(F.col("cand_primary_score") - F.col("base_primary_score")).alias("value"))
    named = lambda n, **k: ev.interval(ev.bootstrap_means(d, samples=1000, **k)).withColumn("variant", F.lit(n))
    return named("choice", seed=20260715).unionByName(named("integers", seed=42))


@query("q03_bootstrap_pareto")
def q03(spark, sf):
    from ..operators.deployment import bootstrap_pareto

    return bootstrap_pareto(_bundled(spark, sf), samples=100, seed=7)


_MC = "m AS (SELECT repeat_id, count(*) FILTER (s2 > s1) AS wins, count(*) FILTER (s2 < s1) AS losses FROM pr GROUP BY 1)"


@query("q04_mcnemar", sql("episodes", f"{_PAIRS}, {_MC} SELECT repeat_id, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(gamma(wins + losses + 1) / (gamma(i + 1) * gamma(wins + losses - i + 1))) FROM range(0, least(wins, losses) + 1) t(i)) / power(2, wins + losses)) END, 6) AS p FROM m"))
def q04(spark, sf):
    b, c = F.col("base_success").cast("int"), F.col("cand_success").cast("int")
    m = ev.paired(traces.episodes(spark, sf)).groupBy("repeat_id").agg(F.count_if(c > b).alias("wins"), F.count_if(c < b).alias("losses"))
    return m.select("repeat_id", "wins", "losses", F.round(ev.mcnemar(F.col("wins"), F.col("losses")), 6).alias("p"))


@query("q05_pearson", sql("episodes", f"{_PAIRS} SELECT round(covar_pop(p1, p2) / (stddev_pop(p1) * stddev_pop(p2)), 6) AS r, NULL::DOUBLE AS constant_r FROM pr"))
def q05(spark, sf):
    p = ev.paired(traces.episodes(spark, sf)).withColumn("one", F.lit(1.0))
    return p.agg(F.round(ev.pearson("base_primary_score", "cand_primary_score"), 6).alias("r"), ev.pearson("one", "cand_primary_score").alias("constant_r"))


@query("q06_seeded_partition")
def q06(spark, sf):
    from ..operators.manifests import partition

    return partition(traces.episodes(spark, sf).select("sample_id").distinct(), {"refine": 30, "gate": 20, "holdout": 20}, seed=20260715)


@query("q07_difference_in_differences")
def q07(spark, sf):
    """Candidate minus baseline, second repeat minus first, with a task bootstrap."""
    d = ev.paired(traces.episodes(spark, sf)).withColumn("d", F.col("cand_primary_score") - F.col("base_primary_score"))
    did = d.groupBy("sample_id").agg((F.avg(F.when(F.col("repeat_id") == 1, F.col("d"))) - F.avg(F.when(F.col("repeat_id") == 0, F.col("d")))).alias("value")).where("value is not null")
    return ev.interval(ev.bootstrap_means(did, samples=1000, seed=42)).crossJoin(did.agg(F.round(F.avg("value"), 6).alias("estimate")))  # one row each


@query("q08_noninferiority_gate")
def q08(spark, sf):
    """Gate: mean difference at least 0 and one-sided lower bound at least -0.03."""
    d = ev.paired(traces.episodes(spark, sf)).groupBy("sample_id").agg(F.avg(F.col("cand_success").cast("int") - F.col("base_success").cast("int")).alias("value"))
    i = ev.interval(ev.bootstrap_means(d, samples=1000, seed=42)).crossJoin(d.agg(F.avg("value").alias("mean_delta")))  # one row each
    return i.select(F.round("mean_delta", 6).alias("mean_delta"), F.round("one_sided_low", 6).alias("lower_bound"), ((F.col("mean_delta") >= 0) & (F.col("one_sided_low") >= -0.03)).alias("passes"))


@query("q09_interval_table")
def q09(spark, sf):
    """Intervals of several paired measures, unpivoted."""
    p = ev.paired(traces.episodes(spark, sf))
    out = None
    for m in ("primary_score", "steps", "invalid_actions", "input_tokens"):
        d = p.groupBy("sample_id").agg(F.avg(F.col(f"cand_{m}") - F.col(f"base_{m}")).alias("value"))
        row = ev.interval(ev.bootstrap_means(d, samples=500, seed=42)).withColumn("measure", F.lit(m))
        out = row if out is None else out.unionByName(row)
    return out
