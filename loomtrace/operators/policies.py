"""Decision graphs and the policies read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from .labels import KEY, reward_band

#: Percent weights of the seven key fields; whole numbers, so the boundary of 75 is exact.
PERCENT = {"event_type": 25, "attribute_count": 10, "option_count": 10, "requires_price_check": 10, "signal": 25, "price_signal": 10, "repeated_event": 10}


def nodes_of(decisions: DataFrame, reward: str = "reward") -> DataFrame:
    """Decision nodes: key, support, mean reward, shares of the bands low, partial and exact, sorted members."""
    band = reward_band(F.col(reward))
    share = lambda b: F.count_if(band == b) / F.count("*")
    member = F.concat_ws(":", "trajectory_id", F.col("step_index").cast("string"))
    return decisions.groupBy("node_id", *KEY).agg(F.count("*").alias("support"), F.avg(reward).alias("mean_reward"), F.array(share("low"), share("partial"), share("exact")).alias("bands"), F.array_sort(F.collect_list(member)).alias("members"))


def transitions(decisions: DataFrame, reward: str = "reward") -> DataFrame:
    """Observed node transitions: support, mean reward, bands, and the share of the source's outgoing transitions."""
    w = Window.partitionBy("trajectory_id").orderBy("step_index")
    p = decisions.select(F.col("node_id").alias("source"), F.lead("node_id").over(w).alias("target"), F.col(reward).alias("r")).where("target is not null")
    band = reward_band(F.col("r"))
    share = lambda b: F.count_if(band == b) / F.count("*")
    e = p.groupBy("source", "target").agg(F.count("*").alias("support"), F.avg("r").alias("mean_reward"), F.array(share("low"), share("partial"), share("exact")).alias("bands"))
    return e.withColumn("strength", F.col("support") / F.sum("support").over(Window.partitionBy("source")))


def match_percent(a: str, b: str) -> Column:
    out = F.lit(0)
    for field, weight in PERCENT.items():
        out = out + F.when(F.col(f"{a}.{field}").eqNullSafe(F.col(f"{b}.{field}")), weight).otherwise(0)
    return out


def similar(nodes: DataFrame, least: int = 75) -> DataFrame:
    """Directed pairs of different nodes of one event that match in at least ``least`` percent."""
    a, b = nodes.alias("a"), nodes.alias("b")
    j = a.join(b, (F.col("a.event_type") == F.col("b.event_type")) & (F.col("a.node_id") != F.col("b.node_id")))
    return j.select(F.col("a.node_id").alias("source"), F.col("b.node_id").alias("target"), match_percent("a", "b").alias("percent")).where(F.col("percent") >= least)


def branch_graph(decisions: DataFrame, reward: str = "reward") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): observed and semantic edges; the weight is 0.4 semantic, 0.4 transition, 0.2 outcome where observed, else 0.6 and 0.4."""
    # Three branches read the labelled steps: they are kept once, with the few columns that those need.
    decisions = decisions.select("node_id", *KEY, "trajectory_id", "step_index", reward).persist()
    nodes = nodes_of(decisions, reward).persist()
    seen = transitions(decisions, reward)
    every = seen.select("source", "target").unionByName(similar(nodes).select("source", "target")).distinct()
    side = lambda c: nodes.select(F.col("node_id").alias(c), F.struct(*KEY).alias(f"{c}_key"), F.col("bands").alias(f"{c}_bands"))
    e = every.join(seen, ["source", "target"], "left").join(side("source"), "source").join(side("target"), "target")
    percent = F.lit(0)
    for field, weight in PERCENT.items():
        percent = percent + F.when(F.col(f"source_key.{field}").eqNullSafe(F.col(f"target_key.{field}")), weight).otherwise(0)
    e = e.withColumn("support", F.coalesce("support", F.lit(0))).withColumn("semantic", percent / 100).withColumn("strength", F.coalesce("strength", F.lit(0.0))).withColumn("outcome", vx.cosine(F.col("source_bands"), F.col("target_bands"), 0.0))
    # Tenths of a percentage are whole, so no rounding comes before the division.
    weight = F.when(F.col("support") > 0, percent * 4 / 10 / 100 + 0.4 * F.col("strength") + 0.2 * F.col("outcome")).otherwise(percent * 6 / 10 / 100 + 0.4 * F.col("outcome"))
    return nodes, e.withColumn("weight", weight)


def signed(edges: DataFrame, penalty: float = 1.0) -> DataFrame:
    """Symmetric signed adjacency: positive = weight (exact + partial / 2), negative = weight low; unobserved edges take the geometric mean of their ends' bands.

    The bands are weighed together, so what differs by less than a product's rounding stays an entry."""
    band = lambda i: F.when(F.col("support") > 0, F.get("bands", F.lit(i))).otherwise(F.sqrt(F.get("source_bands", F.lit(i)) * F.get("target_bands", F.lit(i))))
    a = edges.select("source", "target", (F.col("weight") * (band(2) + 0.5 * band(1) - penalty * band(0))).alias("v"))
    both = a.unionByName(a.select(F.col("target").alias("source"), F.col("source").alias("target"), "v"))
    return both.groupBy("source", "target").agg((F.sum("v") / 2).alias("adjacency")).where("adjacency <> 0")


def branch_rules(nodes: DataFrame, edges: DataFrame, *, least_support: int = 10, least_gain: float = 0.1, least_sources: int = 2) -> DataFrame:
    """Rules (source, preferred, avoided signal) of each option count: at a source, the best and the worst follow-up of
    support 3 or more; kept where enough sources agree."""
    key = lambda c: nodes.select(F.col("node_id").alias(c), F.col("signal").alias(f"{c}_signal"), F.col("option_count").alias(f"{c}_options"))
    e = edges.where("support > 0").join(key("source"), "source").join(key("target"), "target").where("source_options = target_options")
    t = e.groupBy(F.col("source_options").alias("options"), "source", "source_signal", "target_signal").agg(F.sum("support").alias("n"), (F.sum(F.col("mean_reward") * F.col("support")) / F.sum("support")).alias("r")).where("n >= 3")
    best = t.groupBy("options", "source", "source_signal").agg(
        F.max(F.struct("r", "n", "target_signal")).alias("best"), F.min_by(F.struct("r", "n", "target_signal"), F.struct("r", -F.col("n"), "target_signal")).alias("worst"), F.count("*").alias("c")
    )
    b = best.where((F.col("c") >= 2) & (F.col("best.r") - F.col("worst.r") >= least_gain))
    g = b.groupBy("options", "source_signal", F.col("best.target_signal").alias("preferred"), F.col("worst.target_signal").alias("avoided")).agg(
        F.count("*").alias("sources"), F.sum("best.n").alias("preferred_support"), F.sum("worst.n").alias("avoided_support"),
        (F.sum(F.col("best.r") * F.col("best.n")) / F.sum("best.n")).alias("preferred_reward"), (F.sum(F.col("worst.r") * F.col("worst.n")) / F.sum("worst.n")).alias("avoided_reward"),
    )
    g = g.withColumn("gain", F.col("preferred_reward") - F.col("avoided_reward"))
    return g.where((F.col("sources") >= least_sources) & (F.col("preferred_support") >= least_support) & (F.col("avoided_support") >= least_support) & (F.col("gain") >= least_gain))


def backbone(links: DataFrame, starts: tuple[str, ...], goal: str, longest: int = 7) -> DataFrame:
    """Best simple path over (source, target, support) from a start to the goal: by its weakest link, then the product of
    its links, then shorter, then the later in order. Paths over a few dozen signals grow one link a round."""
    spark = links.sparkSession
    links = links.groupBy("source", "target").agg(F.sum("support").cast("long").alias("support")).where("support > 0")
    paths = spark.createDataFrame([([s], None, 1.0) for s in starts], "path array<string>, weakest long, product double")
    done = None
    for _ in range(longest):
        at_goal = paths.where(F.element_at("path", -1) == goal)
        done = at_goal if done is None else done.unionByName(at_goal)
        more = paths.where(F.element_at("path", -1) != goal).withColumn("end", F.element_at("path", -1))
        j = more.join(links, F.col("end") == F.col("source")).where(~F.array_contains("path", F.col("target")))
        paths = j.select(F.concat("path", F.array("target")).alias("path"), F.least(F.coalesce("weakest", "support"), "support").alias("weakest"), (F.col("product") * F.col("support")).alias("product"))
    return done.orderBy(F.desc("weakest"), F.desc("product"), F.size("path"), F.desc(F.array_join("path", "\x01"))).limit(1).select(F.array_join("path", ">").alias("path"), "weakest")
