"""Structural proposals: splits and merges of clusters that are no worse than leaving them, and the children of a split.

A proposal is a component of the lineage between an old and a new partition. It is judged on the segments that both sides of the component
hold: purity of outcomes, purity of events, and compactness around recomputed centroids, old against new. Components, members and scores are
tables; no row lists members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..staging import staged
from .deployment import centroids, fronts, overlaps
from .graphs import component_labels
from .validation import require_empty

GAINS = ("outcome_gain", "role_gain", "compactness_gain")


def lineage_members(old: DataFrame, new: DataFrame, **thresholds: float) -> DataFrame:
    """(component, side, cluster): clusters of both partitions by connected component of their overlaps; one without overlaps is alone. ``old``: segment_id,
    old_id; ``new``: segment_id, new_id (whole numbers, not negative)."""
    links = staged(overlaps(old, new, **thresholds), "links")
    name = lambda side, c: F.concat(F.lit(side), F.lpad(F.col(c).cast("string"), 12, "0"))
    labels = component_labels(links.select(name("a", "old_id").alias("i"), name("b", "new_id").alias("j")))
    every = old.select(F.lit("old").alias("side"), F.col("old_id").cast("long").alias("cluster"), name("a", "old_id").alias("node"))
    every = every.unionByName(new.select(F.lit("new").alias("side"), F.col("new_id").cast("long").alias("cluster"), name("b", "new_id").alias("node"))).distinct()
    return every.join(labels, "node", "left").select(F.coalesce("label", "node").alias("component"), "side", "cluster")


def _scores(rows: DataFrame, cluster: str) -> DataFrame:
    """(component, outcome, role, compactness) of one side's clusters, weighed by their sizes."""
    rows = rows.withColumn("part", F.concat_ws("/", "component", cluster))

    def purity(label: str) -> DataFrame:
        best = rows.groupBy("component", "part", label).agg(F.count("*").alias("n")).groupBy("component", "part").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
        return best.groupBy("component").agg((F.sum("top") / F.sum("n")).alias(label))

    near = rows.join(centroids(rows, "part", "embedding"), "part")
    compactness = near.groupBy("component").agg(F.avg(vx.cosine(F.col("embedding"), F.col("centroid"), 0.0)).alias("compactness"))
    return purity("outcome").join(purity("event_type").withColumnRenamed("event_type", "role"), "component").join(compactness, "component")


def proposals(old: DataFrame, new: DataFrame, evidence: DataFrame, *, coverage: float = 0.8, tolerance: float = 1e-9, **thresholds: float) -> DataFrame:
    """(component, action, outcome_gain, role_gain, compactness_gain, front): splits and merges whose new side holds at least ``coverage`` of the old
    side's segments, and that dominate leaving things as they are: no gain below ``-tolerance``, some above it. ``front`` ranks them by their gains,
    rounded to nine digits. ``evidence``: segment_id, outcome, event_type, embedding, for every segment of the old partition."""
    if not 0 < coverage <= 1:
        raise ValueError("coverage must lie above 0 and not above 1")
    members = staged(lineage_members(old, new, **thresholds), "members")
    count = lambda side: F.count_if(F.col("side") == side)
    kinds = members.groupBy("component").agg(count("old").alias("a"), count("new").alias("b"))
    action = F.when((F.col("a") == 1) & (F.col("b") > 1), "split").when((F.col("a") > 1) & (F.col("b") == 1), "merge")
    kinds = kinds.select("component", action.alias("action")).where("action is not null")
    side = lambda rows, column, name: rows.join(members.where(F.col("side") == name).select(F.col("cluster").alias(column), "component"), column)
    before, after = side(old, "old_id", "old").join(kinds, "component"), side(new, "new_id", "new")
    shared = before.join(after, ["segment_id", "component"])
    enough = before.groupBy("component").agg(F.count("*").alias("all")).join(shared.groupBy("component").agg(F.count("*").alias("both")), "component").where(F.col("both") / F.col("all") >= coverage)
    judged = staged(shared.join(enough.select("component"), "component"), "judged")
    require_empty(judged.join(evidence.select("segment_id"), "segment_id", "left_anti").select("segment_id"), "segments without evidence")
    rows = staged(judged.join(evidence.select("segment_id", "outcome", "event_type", "embedding"), "segment_id"), "evidence")
    mine = _scores(rows, "old_id").withColumnsRenamed({"outcome": "o0", "role": "r0", "compactness": "c0"})
    gain = lambda a, b: F.round(F.col(a) - F.col(b), 9)
    gains = _scores(rows, "new_id").join(mine, "component").select("component", *[gain(a, b).alias(n) for a, b, n in zip(("outcome", "role", "compactness"), ("o0", "r0", "c0"), GAINS)])
    every, some = F.lit(True), F.lit(False)
    for g in GAINS:
        every, some = every & (F.col(g) >= -tolerance), some | (F.col(g) > tolerance)
    return fronts(staged(gains.where(every & some).join(kinds, "component"), "proposals"), GAINS, "component").select("component", "action", *GAINS, "front")


def selected(found: DataFrame) -> DataFrame:
    """The best split and the best merge: by front, then gains, then the smaller component."""
    w = Window.partitionBy("action").orderBy("front", *[F.desc(g) for g in GAINS], "component")
    return found.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def shadow_split(source: DataFrame, candidates: DataFrame, historical: DataFrame, vectors: DataFrame, child_centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, centroids) of a split's children.

    members: child, segment_id, residual. A child keeps those candidate members that the source holds, or whose trajectory is no historical one; what is left of the source
    goes to the child whose candidate centroid is nearest, of equal ones to the larger id. Centroids are then taken anew over all members.
    source: segment_id; candidates: segment_id, trajectory_id, child (each segment in one child); historical: trajectory_id; vectors: segment_id, vector;
    child_centroids: child, centroid."""
    require_empty(candidates.groupBy("segment_id").agg(F.count_distinct("child").alias("n")).where("n > 1"), "children of a split overlap")
    held = candidates.join(source.select("segment_id", F.lit(True).alias("own")), "segment_id", "left").join(historical.select("trajectory_id", F.lit(True).alias("old")).distinct(), "trajectory_id", "left")
    kept = staged(held.where("own is not null or old is null").select("child", "segment_id").distinct(), "children")
    left = source.select("segment_id").distinct().join(kept.select("segment_id"), "segment_id", "left_anti").join(vectors, "segment_id")
    children = child_centroids.agg(F.collect_list(F.struct("child", "centroid")).alias("children"))  # a split's children: few
    score = lambda c: F.struct(F.round(vx.cosine(F.col("vector"), c["centroid"], -1.0), 9).alias("cosine"), c["child"].alias("child"))
    nearest: Column = F.array_max(F.transform("children", score))["child"]
    residual = left.crossJoin(F.broadcast(children)).select(nearest.alias("child"), "segment_id", F.lit(True).alias("residual"))  # one row
    members = staged(kept.withColumn("residual", F.lit(False)).unionByName(residual), "members")
    return members, centroids(members.join(vectors, "segment_id"), "child", "vector")
