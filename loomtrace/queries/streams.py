"""Streaming queries, each equal to the batch result of its oracle; relational extras on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import traces
from ..oracle import sql
from ..streaming import events as st

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _stream(spark, sf, n=2):
    """The events of a table as a stream of a few files in order of time."""
    from ..sources.files import scratch

    path = scratch(spark, "events")
    e = traces.read(spark, sf, "events")
    e.repartitionByRange(n, "ts").sortWithinPartitions("ts").write.parquet(path)
    return st.stream(spark, path)


@query("st_tumbling_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value_sum FROM events GROUP BY 1, 2")
def tumbling(spark, sf):
    return st.drain(st.tumbling(_stream(spark, sf)), "complete")


@query("st_sliding_windows", "SELECT s AS start, event_type, count(*) AS n, round(sum(value), 2) AS value_sum FROM (SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) + INTERVAL (CASE WHEN hour(ts) >= 12 THEN 12 ELSE -12 END) HOUR]) AS s FROM events) GROUP BY 1, 2")
def sliding(spark, sf):
    return st.drain(st.tumbling(_stream(spark, sf), "1 day", slide="12 hours"), "complete")


@query("st_session_windows", "WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM x) SELECT min(ts) AS start, user_id, count(*) AS n FROM r GROUP BY user_id, run")
def session_windows(spark, sf):
    return st.drain(st.sessions(_stream(spark, sf)), "complete")


@query("st_deduplicated_stream", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def deduplicated(spark, sf):
    from ..sources.files import scratch

    path = scratch(spark, "twice")
    e = traces.read(spark, sf, "events")
    e.unionByName(e).repartition(2).write.parquet(path)
    return st.drain(st.once_per_key(st.stream(spark, path), "event_id")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def _shuffled(spark, sf, n=2):
    """The events in ``n`` batches of files that know no order, and a last one far behind them in time: it lets the watermark pass them all."""
    from ..sources.files import scratch

    path = scratch(spark, "shuffled")
    e = traces.read(spark, sf, "events")
    mixed = F.xxhash64("event_id", F.lit(1))
    files = 1
    for k in range(n):
        # Adaptive execution makes as many files as the rows need, so no task has a whole batch.
        part = e.where(F.pmod(F.xxhash64("event_id"), F.lit(n)) == k).repartition(mixed).sortWithinPartitions(mixed)
        part.write.mode("append").parquet(path)
        files = max(files, -(-len(spark.read.parquet(path).inputFiles()) // (k + 1)))
    last = e.agg((F.max("ts") + F.expr("interval 1000 days")).alias("ts"))
    last.select(F.lit(-1).cast("long").alias("event_id"), "ts", *[F.lit(None).cast(e.schema[c].dataType).alias(c) for c in e.columns if c not in ("event_id", "ts")]).select(*e.columns).write.mode("append").parquet(path)
    return st.stream(spark, path, files=files)


@query("st01_streaming_state", sql("machine", "SELECT trajectory_id, step_index::BIGINT AS step_index, event AS shop_event FROM machine WHERE step_index >= 0"))
def state(spark, sf):
    """Every step's event from a stream that brings the events in no order."""
    steps = traces.weekly(_shuffled(spark, sf, 2)).select("trajectory_id", "ts", "event_id", *traces.shop_action())
    return st.drain(st.page_states(steps, late="400 days")).where("event_id >= 0").select("trajectory_id", "step_index", "shop_event")


# ---- categories that plain Spark covers, on the star schema


@query("sql_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing(spark, sf):
    l = traces.read(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("sql_star_join", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def star(spark, sf):
    t = lambda n: traces.read(spark, sf, n)
    n = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf):
    return traces.read(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("sql_as_of_join", "SELECT event_id, (SELECT max(o.event_id) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'view' AND o.ts <= e.ts) AS view_id FROM events e WHERE event_type = 'purchase'")
def as_of(spark, sf):
    """The last view at or before each purchase: one ordered window a user, no range join."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    e = traces.read(spark, sf, "events").withColumn("view_id", F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(w))
    return e.where("event_type = 'purchase'").select("event_id", "view_id")
