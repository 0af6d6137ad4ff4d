"""Deployment analytics: bundles, purity, centroids, lineage, Pareto fronts, structural proposals."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..staging import numbered, staged
from .evaluation import guarded_saving, resample_counts

#: Vectors that are ranked in one task: with two objectives, and with more (each is held against all before it there).
CHAIN_ROWS, CHAIN_BLOCK = 1 << 18, 1 << 12


def bundle_metrics(pairs: DataFrame) -> DataFrame:
    """Exposure and three objectives of each bundle of feedback pairs."""
    b, c = F.col("base_success").cast("int"), F.col("cand_success").cast("int")
    return pairs.groupBy("bundle").agg(F.count("*").alias("exposure"), F.avg(c).alias("performance"), F.avg(c - b).alias("gain"), F.avg(guarded_saving()).alias("saving"))


def purity(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, purity, size): share of the most frequent label."""
    counts = rows.groupBy(cluster, label).agg(F.count("*").alias("n"))
    return counts.groupBy(cluster).agg((F.max("n") / F.sum("n")).alias("purity"), F.sum("n").alias("size"))


def centroids(rows: DataFrame, cluster: str, vector: str, weight: str | None = None) -> DataFrame:
    """(cluster, centroid): mean of the vectors, weighed if asked, one sum a dimension."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    flat = rows.select(cluster, w.alias("w"), F.posexplode(vector).alias("dim", "x"))
    means = flat.groupBy(cluster, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def compactness(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    j = rows.join(centroids(rows, cluster, vector), cluster)
    return j.groupBy(cluster).agg(F.avg(vx.cosine(F.col(vector), F.col("centroid"), 0.0)).alias("compactness"), F.count("*").alias("size"))


def overlaps(old: DataFrame, new: DataFrame, *, least_retention: float = 0.0, least_purity: float = 0.0) -> DataFrame:
    """(old_id, new_id, shared, retention, purity) of cluster pairs that share members and reach either threshold."""
    shared = old.join(new, "segment_id").groupBy("old_id", "new_id").agg(F.count("*").alias("shared"))
    sized = shared.join(old.groupBy("old_id").agg(F.count("*").alias("n_old")), "old_id").join(new.groupBy("new_id").agg(F.count("*").alias("n_new")), "new_id")
    sized = sized.select("old_id", "new_id", "shared", (F.col("shared") / F.col("n_old")).alias("retention"), (F.col("shared") / F.col("n_new")).alias("purity"))
    return sized.where((F.col("retention") >= least_retention) | (F.col("purity") >= least_purity))


def lineage(old: DataFrame, new: DataFrame, **thresholds: float) -> DataFrame:
    """(component, kind, old_ids, new_ids): connected components of overlapping clusters, by smallest label."""
    from .graphs import component_labels

    links = overlaps(old, new, **thresholds)
    name = lambda side, c: F.concat(F.lit(side), F.lpad(F.col(c).cast("string"), 12, "0"))
    named = links.select(name("a", "old_id").alias("i"), name("b", "new_id").alias("j"))
    labels = component_labels(named)
    every = old.select(name("a", "old_id").alias("node")).unionByName(new.select(name("b", "new_id").alias("node"))).distinct()
    full = every.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"))
    g = full.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("m"))
    olds, news = F.filter("m", lambda x: x.startswith("a")), F.filter("m", lambda x: x.startswith("b"))
    a, b = F.size(olds), F.size(news)
    kind = F.when(a == 0, "new").when(b == 0, "disappeared").when((a == 1) & (b == 1), "continuation").when(a == 1, "split").when(b == 1, "merge").otherwise("recomposed")
    ids = lambda x: F.transform(x, lambda s: F.substring(s, 2, 12).cast("long"))
    return g.select("component", kind.alias("kind"), ids(olds).alias("old_ids"), ids(news).alias("new_ids"))


def _dominates(a: str, b: str, objectives: tuple[str, ...]) -> Column:
    every, some = F.lit(True), F.lit(False)
    for o in objectives:
        every = every & (F.col(f"{a}.{o}") >= F.col(f"{b}.{o}"))
        some = some | (F.col(f"{a}.{o}") > F.col(f"{b}.{o}"))
    return every & some


def undominated(x: np.ndarray) -> np.ndarray:
    """Rows of distinct objectives that no other row dominates. Whoever dominates a row has a greater sum, so rows are
    held against the front found so far, in the order of their sums."""
    front = np.zeros((0, x.shape[1]))
    for row in x[np.argsort(-x.sum(axis=1), kind="stable")]:
        if not (front >= row).all(axis=1).any():
            front = np.vstack([front, row])
    return front


def skyline(items: DataFrame, objectives: tuple[str, ...]) -> DataFrame:
    """Distinct objective vectors that none dominates: fronts of partitions, merged eight to one, so a task holds front members only."""
    flat = items.select(*[F.col(o).cast("double").alias(o) for o in objectives]).dropna().distinct()
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, len(objectives)))
        for b in batches:
            held = undominated(np.vstack([held, b.to_numpy(float)]))
        yield pd.DataFrame(held, columns=list(objectives))

    while True:
        flat = flat.repartition(parts).mapInPandas(local, flat.schema)
        if parts == 1:
            return flat
        parts = -(-parts // 8)


def first_front(items: DataFrame, objectives: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """Items that no other (of their group) dominates; one that lacks an objective is dominated by none."""
    if within:
        on = _dominates("o", "i", objectives)
        for c in within:
            on = on & (F.col(f"o.{c}") == F.col(f"i.{c}"))
        return items.alias("i").join(items.alias("o"), on, "left_anti")
    best = skyline(items, objectives)
    on, lacking = F.lit(True), F.lit(False)
    named = best.select(*[F.col(o).alias(f"_best_{i}") for i, o in enumerate(objectives)])
    for i, o in enumerate(objectives):
        on, lacking = on & (F.col(o).cast("double") == F.col(f"_best_{i}")), lacking | F.col(o).isNull()
    return items.join(named, on, "left_semi").unionByName(items.where(lacking))


def _chain(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Ranks of distinct vectors in descending order: one more than the greatest rank among those before that are as great in all
    objectives, and than ``base``, what is known from elsewhere."""
    rank = np.zeros(len(x), np.int64)
    if x.shape[1] <= 2:
        # The greatest last objective (negated) of each rank and beyond so far; it falls as ranks rise, so the rank sought is found by halving.
        last, top = (-x[:, -1]).tolist(), []
        for i, (v, b) in enumerate(zip(last, base.tolist())):
            r = max(bisect_right(top, v), b)
            rank[i] = r + 1
            # ``top`` of a rank counts higher ranks as well, so it has no gaps where ranks are skipped for a base.
            known = len(top)
            top += [v] * (r + 1 - known)
            for k in range(min(r, known - 1), -1, -1):
                if top[k] <= v:
                    break
                top[k] = v
        return rank
    for i in range(len(x)):
        above = rank[:i][(x[:i] >= x[i]).all(axis=1)]
        rank[i] = 1 + max(int(above.max(initial=0)), int(base[i]))
    return rank


def _upper_bounds(before: DataFrame, after: DataFrame, n: int) -> DataFrame:
    """(place, base): the greatest rank among vectors of ``before`` that are as great as a vector of ``after`` in all objectives but the first,
    which they are by their order."""
    if n <= 2:
        # One objective is left: a running maximum down its order, range by range. Equal ones of ``before`` come first.
        o = F.col(f"o{n - 1}")
        both = before.select(o.alias("v"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("place"), "rank").unionByName(after.select(o.alias("v"), F.lit(1).alias("side"), "place", F.lit(0).cast("long").alias("rank")))
        kept = staged(both.repartitionByRange(F.desc("v"), "side").sortWithinPartitions(F.desc("v"), "side").withColumn("at", F.monotonically_increasing_id()), "sweep")
        part = F.shiftright("at", 33)
        most = sorted(kept.groupBy(part.alias("p")).agg(F.max("rank").alias("m")).collect())  # one row a partition
        carried, high = [], 0
        for p, m in most:
            carried.append((p, high))
            high = max(high, m)
        starts = before.sparkSession.createDataFrame(carried, "p long, carried long")
        upto = F.max("rank").over(Window.partitionBy("p").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        swept = kept.withColumn("p", part).join(F.broadcast(starts), "p").withColumn("base", F.greatest(upto, F.col("carried")))
        return swept.where("side = 1").select("place", "base")
    names = [f"o{k}" for k in range(n)]
    # Blocks of vectors meet blocks of vectors, but only where some of one may be as great as some of the other.
    blocked = lambda rows: rows.withColumn("block", F.floor(F.col("place") / CHAIN_BLOCK))
    boxes = lambda rows, f: blocked(rows).groupBy("block").agg(*[f(o).alias(o) for o in names])
    can = F.lit(True)
    for o in names[1:]:
        can = can & (F.col(f"h.{o}") >= F.col(f"l.{o}"))
    meet = boxes(before, F.max).alias("h").join(boxes(after, F.min).alias("l"), can).select(F.col("h.block").alias("high"), F.col("l.block").alias("low"))  # a row a pair of blocks
    meet = staged(meet, "meet")
    cell = lambda rows, side, mine: blocked(rows).join(meet, F.col("block") == F.col(mine)).select("high", "low", F.lit(side).alias("side"), "place", "rank", *names)
    both = cell(before, 0, "high").unionByName(cell(after.withColumn("rank", F.lit(0).cast("long")), 1, "low"))

    def most(part: pd.DataFrame) -> pd.DataFrame:
        h, l = part[part["side"] == 0].sort_values("rank", ascending=False), part[part["side"] == 1]  # noqa: E741
        a, b, ranks = h[names].to_numpy(float), l[names].to_numpy(float), h["rank"].to_numpy()
        found = np.zeros(len(b), np.int64)
        for at in range(0, len(b), 512):
            ok = np.ones((len(b[at : at + 512]), len(a)), bool)
            for k in range(1, n):
                ok &= a[None, :, k] >= b[at : at + 512, None, k]
            first = ok.argmax(axis=1)  # ranks fall
            found[at : at + 512] = np.where(ok.any(axis=1), ranks[first], 0)
        return pd.DataFrame({"place": l["place"].to_numpy(), "base": found})

    return both.groupBy("high", "low").applyInPandas(most, "place long, base long").groupBy("place").agg(F.max("base").alias("base"))


def fronts(items: DataFrame, objectives: tuple[str, ...], key: str = "item_id") -> DataFrame:
    """Items with their front: 1 where none dominates an item, else one more than the greatest front among those that dominate it.

    Distinct vectors are numbered in descending order, so whoever dominates one stands before it. Blocks of ``CHAIN_ROWS`` (with three and
    more objectives ``CHAIN_BLOCK``) are settled in that order, halves before halves: a settled half gives the other one the ranks
    that it builds on, by a running maximum down the second objective, or by pairs of blocks. A block is one task; the number of
    jobs grows with the number of blocks, not with that of fronts. An item that lacks an objective is dominated by none, and dominates none."""
    n = len(objectives)
    names = [f"o{k}" for k in range(n)]
    flat = items.select(*[F.col(o).cast("double").alias(f"o{k}") for k, o in enumerate(objectives)]).dropna().distinct()
    placed = staged(numbered(flat, *[F.desc(o) for o in names]), "vectors")
    rows, size = placed.count(), CHAIN_ROWS if n <= 2 else CHAIN_BLOCK
    schema = "place long, rank long, " + ", ".join(f"{o} double" for o in names)

    def settle(low: int, high: int, base: DataFrame | None) -> DataFrame:
        here = placed.where(F.col("place").between(low, high - 1))
        if high - low <= size:
            known = here.join(base.select(F.col("place").alias("b_place"), "base"), F.col("place") == F.col("b_place"), "left").select("place", *names, F.coalesce("base", F.lit(0)).alias("base")) if base is not None else here.select("place", *names, F.lit(0).cast("long").alias("base"))

            def ranks(part: pd.DataFrame) -> pd.DataFrame:
                part = part.sort_values("place")
                return part.assign(rank=_chain(part[names].to_numpy(float), part["base"].to_numpy()))[["place", "rank", *names]]

            return staged(known.groupBy(F.lit(0).alias("block")).applyInPandas(ranks, schema), "ranks")
        mid = low + size * max(1, (high - low) // (2 * size))
        first = settle(low, mid, base)
        rest = placed.where(F.col("place").between(mid, high - 1))
        more = _upper_bounds(first, rest, n)
        both = more if base is None else more.unionByName(base.select("place", "base").where(F.col("place") >= mid)).groupBy("place").agg(F.max("base").alias("base"))
        return first.unionByName(settle(mid, high, staged(both, "base")))

    ranked = settle(0, rows, None).drop("place").select(*[F.col(o).alias(f"_{o}") for o in names], F.col("rank").cast("int").alias("front"))
    on, lacking = F.lit(True), F.lit(False)
    for k, o in enumerate(objectives):
        on, lacking = on & (F.col(o).cast("double") == F.col(f"_o{k}")), lacking | F.col(o).isNull()
    return items.join(ranked, on).select(*items.columns, "front").unionByName(items.where(lacking).withColumn("front", F.lit(1)))


def bootstrap_pareto(pairs: DataFrame, *, samples: int, seed: int, least_exposure: int = 1) -> DataFrame:
    """Bundle metrics with the share of task resamples in which the bundle is on the first front.

    Draws are a table (b, place, task): the resamples are then grouped sums and an anti-join per sample, in parallel."""
    spark = pairs.sparkSession
    tasks = numbered(pairs.select("sample_id").distinct(), "sample_id", name="task")
    n = tasks.count()
    draws = resample_counts(spark, n, samples, seed)
    # What draws come from is tiny, so a plan without this hint broadcasts them.
    rows = pairs.join(tasks, "sample_id").join(draws.hint("merge"), "task")
    b, c, t = F.col("base_success").cast("int"), F.col("cand_success").cast("int"), F.col("times")
    mean = lambda x: F.sum(x * t) / F.sum(t)
    sampled = rows.groupBy("b", "bundle").agg(mean(c).alias("performance"), mean(c - b).alias("gain"), mean(guarded_saving()).alias("saving"))
    front = first_front(sampled, ("performance", "gain", "saving"), ("b",)).groupBy("bundle").agg(F.count("*").alias("on_front"))
    present = sampled.groupBy("bundle").agg(F.count("*").alias("present"))
    metrics = bundle_metrics(pairs).where(F.col("exposure") >= least_exposure)
    j = metrics.join(present, "bundle", "left").join(front, "bundle", "left")
    return j.select("bundle", "exposure", "performance", "gain", F.round("saving", 6).alias("saving"), F.round(F.coalesce(F.col("on_front") / F.col("present"), F.lit(0.0)), 6).alias("front_probability"))


def structural_scores(rows: DataFrame, cluster: str) -> DataFrame:
    """One row: outcome purity, event purity and compactness of a partition, weighed by cluster size."""
    o, e = purity(rows, cluster, "outcome"), purity(rows, cluster, "event_type")
    c = compactness(rows, cluster, "embedding")
    j = o.select(cluster, F.col("purity").alias("o"), "size").join(e.select(cluster, F.col("purity").alias("e")), cluster).join(c.select(cluster, "compactness"), cluster)
    w = lambda x: F.sum(F.col(x) * F.col("size")) / F.sum("size")
    return j.agg(w("o").alias("outcome_purity"), w("e").alias("role_purity"), w("compactness").alias("compactness"))
