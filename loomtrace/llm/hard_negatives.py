"""Hard negatives by a k-nearest-neighbour join over Voronoi cells of norm-augmented vectors.

A component that makes all candidates equally long turns inner products into distances: with M the greatest norm, a candidate
x becomes (x, sqrt(M^2 - |x|^2)), an anchor q becomes (q, 0), and their product is (|q|^2 + M^2 - d^2) / 2. Candidates belong to
the cell of their nearest pivot; anchors form a group for each pivot nearest to them (and label, where only one label counts).
Each group is first joined with its pivot's own cell, which gives every anchor a k-th score. A group's bounds follow: the
distance from its pivot to its farthest anchor, the extreme norms, and the scores that it still seeks. A candidate is
replicated to a group only if the triangle inequality lets one of its products lie among these. Then a local join
multiplies a group's anchors with at most ``BLOCK_ROWS`` of its candidates in a task, and the best of all blocks are merged.

The join runs twice: for positives (same label, any score) and for negatives (another label, a band of scores for each positive).

Defined cases: rows with a null label, id or vector, or a null or non-finite component take no part; rows that repeat an id are rows
of their own, and only the anchor's own row is no positive of it; vectors of different lengths have no product; ties go to the smaller id; fewer
rows than asked for give fewer; an anchor without positives, or a positive with a negative score, has no negatives; components of
any finite size are multiplied exactly, and a score among the best that does not fit a long raises; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .topk_search import EXACT, _coded, _in_groups, _stack, dot, quantised

#: Pivots at most, and vectors of the table for each beyond the first ``LEAST_PIVOTS``.
PIVOTS, LEAST_PIVOTS, PIVOT_ROWS = 64, 8, 65_536
#: Anchors of a group, candidates of a task, candidates multiplied at a time.
GROUP_ROWS, BLOCK_ROWS, CHUNK = 4096, 16_384, 1024
LOW, HIGH = -(1 << 63), (1 << 63) - 1
FOUND = "a_row long, no int, id long, score long"


def _celled(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cell``, ``far`` (their augmented distance to every pivot), and as anchors ``pivot`` and ``reach`` (the distance
    to it). Pivots are at most ``PIVOTS`` rows of the table, by hash."""
    n, most = rows.agg(F.count("*"), F.max("norm")).first()
    count = min(PIVOTS, max(LEAST_PIVOTS, -(-n // PIVOT_ROWS)), max(1, n // 16))
    drawn = [np.array(r["v"]) for r in rows.orderBy(F.xxhash64("row"), "row").limit(count).select("v").collect()]
    width = max([len(v) for v in drawn], default=1)
    pivots = np.array([np.pad(v, (0, width - len(v))) for v in drawn]).reshape(-1, width)
    longest = float(most or 0.0)
    lift = np.sqrt(np.maximum(longest**2 - (pivots**2).sum(axis=1), 0.0))
    held = rows.sparkSession.sparkContext.broadcast((pivots, lift, longest))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, up, m = held.value
        for b in batches:
            for _, part in b.groupby("length"):
                x = _stack(part["v"])
                same = min(x.shape[1], p.shape[1])  # shorter vectors count as padded by zeros
                inner = x[:, :same] @ p[:, :same].T
                own = np.sqrt(np.maximum(m * m - (x**2).sum(axis=1), 0.0))
                # Both ends are m long, so d^2 = 2 (m^2 - product); an anchor is as long as it is.
                far = np.sqrt(np.maximum(2 * (m * m - inner - own[:, None] * up[None, :]), 0.0))
                near = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + m * m - 2 * inner, 0.0))
                pivot = np.argmin(near, axis=1)
                yield part.assign(far=list(far), cell=np.argmin(far, axis=1), pivot=pivot, reach=near[np.arange(len(x)), pivot])

    kind = "row long, id long, length int, v array<double>, norm double, label long, far array<double>, cell int, pivot int, reach double"
    return shared.staged(rows.mapInPandas(measure, kind).withColumn("longest", F.lit(longest)), "cells")


def _grouped(anchors: DataFrame, same: bool) -> DataFrame:
    """``anchors`` with their group: a pivot (and label), dealt into parts of ``GROUP_ROWS``."""
    by = ["pivot", "label"] if same else ["pivot"]
    sizes = anchors.groupBy(*by).agg(F.count("*").alias("held")).select(*[F.col(c).alias("s_" + c) for c in by], "held")
    on = F.lit(True)
    for c in by:
        on = on & (F.col(c) == F.col("s_" + c))
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("held") / GROUP_ROWS))
    return anchors.join(sizes, on).withColumn("grp", F.xxhash64(*by, part)).drop("held", *["s_" + c for c in by])


def _summary(asked: DataFrame) -> DataFrame:
    """One row a group: its pivot, label, radius, extreme norms, and the scores that its anchors seek."""
    least, most = F.array_min(F.transform("bands", lambda b: b["lo"])), F.array_max(F.transform("bands", lambda b: b["hi"]))
    bounds = (F.max("reach").alias("radius"), F.min("norm").alias("shortest"), F.max("norm").alias("furthest"), F.min(least).alias("lo"), F.max(most).alias("hi"))
    return asked.groupBy("grp").agg(F.first("pivot").alias("g_pivot"), F.first("label").alias("g_label"), *bounds)


def _served(cells: DataFrame, groups: DataFrame, same: bool, home: bool) -> DataFrame:
    """(row, grp): candidates of the groups' own cells (``home``), or those of other cells that a group might need."""
    if home:
        on = F.col("cell") == F.col("g_pivot")
        on = on & (F.col("label") == F.col("g_label")) if same else on
        return cells.select("row", "cell", "label").join(groups, on).select("row", "grp")
    far = cells.select("row", "cell", "label", "longest", F.posexplode("far").alias("to", "d")).where("to <> cell")
    on = F.col("to") == F.col("g_pivot")
    on = on & (F.col("label") == F.col("g_label")) if same else on
    m2 = F.col("longest") * F.col("longest")
    near = F.greatest(F.col("d") - F.col("radius"), F.lit(0.0))
    beyond = F.col("d") + F.col("radius")
    slack = 1e-9 * (1 + 8 * m2)  # rounding never hides a candidate
    most = (F.col("furthest") * F.col("furthest") + m2 - near * near) / 2 + slack
    least = (F.col("shortest") * F.col("shortest") + m2 - beyond * beyond) / 2 - slack
    return far.join(groups, on & (most >= F.col("lo").cast("double")) & (least <= F.col("hi").cast("double"))).select("row", "grp")


def _top(s: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, candidate) numbers of the k best scores of every anchor among those that are ``ok``."""
    seen = np.flatnonzero(ok.any(axis=1))
    if not len(seen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if s.dtype == object:
        i, j = np.nonzero(ok)
        order = np.array(sorted(range(len(i)), key=lambda t: (i[t], -s[i[t], j[t]], ids[j[t]])), np.int64)
    else:
        masked = np.where(ok[seen], s[seen], -np.inf)
        if masked.shape[1] > k:
            floor = -np.partition(-masked, k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero((masked >= floor[:, None]) & ok[seen])
        else:
            i, j = np.nonzero(ok[seen])
        i = seen[i]
        order = np.lexsort((ids[j], -s[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    return i[place < k], j[place < k]


def _joined(held: pd.DataFrame, asked: pd.DataFrame, k: int, same: bool) -> Iterator[pd.DataFrame]:
    """The k best candidates of every anchor and band, within one block."""
    for length in np.unique(asked["length"]):
        a, c = asked[asked["length"] == length], held[held["length"] == length]
        if not len(c):
            continue
        q, labels, rows = _stack(a["v"]), a["label"].to_numpy(), a["row"].to_numpy()
        exact = float(a["norm"].max()) * float(c["norm"].max()) < EXACT
        bands = [(i, b["no"], b["lo"], b["hi"]) for i, bs in enumerate(a["bands"]) for b in bs]
        for at in range(0, len(c), CHUNK):
            part = c.iloc[at : at + CHUNK]
            ids = part["id"].to_numpy()
            s = dot(q, _stack(part["v"]), exact)
            alike = labels[:, None] == part["label"].to_numpy()[None, :]
            fit = alike & (rows[:, None] != part["row"].to_numpy()[None, :]) if same else ~alike
            for no in sorted({b[1] for b in bands}):
                mine = [b for b in bands if b[1] == no]
                i = np.array([b[0] for b in mine])
                lo, hi = (np.array([b[e] for b in mine], float if exact else object) for e in (2, 3))
                some = s[i]
                ok = fit[i] & (some >= lo[:, None]).astype(bool) & (some <= hi[:, None]).astype(bool)
                if same and not exact:
                    # Only the best must fit a long; the bounds of positives are those of a long.
                    ok = fit[i]
                x, j = _top(some, ids, ok, k)
                if len(x):
                    score = some[x, j]
                    if score.dtype == object:
                        if any(not LOW <= v <= HIGH for v in score):
                            raise OverflowError("a score does not fit a long")
                        score = np.array([int(v) for v in score], np.int64)
                    yield pd.DataFrame({"a_row": rows[i[x]], "no": np.full(len(x), no, np.int32), "id": ids[j], "score": score.astype(np.int64)})


def _local(cells: DataFrame, served: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """``FOUND`` rows of the best of every block, for candidates dealt to groups."""
    served = shared.staged(served, "served")
    need = served.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")).withColumnRenamed("grp", "n_grp")
    name = F.concat_ws("/", "grp", "block").alias("cell")
    columns = ["row", "id", "length", "v", "norm", "label"]
    band = "array<struct<no: int, lo: long, hi: long>>"
    who = served.withColumnRenamed("row", "s_row").join(need, F.col("grp") == F.col("n_grp"))
    held = cells.select(*columns).join(who, F.col("row") == F.col("s_row")).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    asking = asked.join(need, F.col("grp") == F.col("n_grp")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = held.select(name, F.lit(0).alias("kind"), *columns, F.lit(None).cast(band).alias("bands")).unionByName(asking.select(name, F.lit(1).alias("kind"), *columns, F.col("bands").cast(band)))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _in_groups(_coded(batches), "code"):
            yield from _joined(part[part["kind"] == 0], part[part["kind"] == 1], k, same)

    return shared.staged(both.repartition("cell").sortWithinPartitions("cell", "kind", "row").mapInPandas(join, FOUND), "found")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("a_row", "no").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_join(cells: DataFrame, asked: DataFrame, *, k: int, same: bool) -> DataFrame:
    """(a_row, no, id, score, rank): the k best rows of ``cells`` for every anchor and band of ``asked``, of the anchor's label or of another."""
    asked = shared.staged(_grouped(asked, same), "asked")
    home = _local(cells, _served(cells, _summary(asked), same, home=True), asked, k, same)
    # An anchor that has k rows need not seek below the last of them.
    kth = _best(home, k).where(F.col("rank") == k).groupBy("a_row").agg(F.map_from_entries(F.collect_list(F.struct("no", "score"))).alias("kth"))
    raised = F.transform("bands", lambda b: F.struct(b["no"].alias("no"), F.greatest(b["lo"], F.col("kth")[b["no"]]).alias("lo"), b["hi"].alias("hi")))
    more = asked.join(kth, F.col("row") == F.col("a_row"), "left").withColumn("bands", F.when(F.col("kth").isNull(), F.col("bands")).otherwise(raised)).drop("a_row", "kth")
    more = shared.staged(more, "seeking")
    away = _local(cells, _served(cells, _summary(more), same, home=False), more, k, same)
    return _best(home.unionByName(away), k)


def mine(frame: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank, anchor_row) for the rows whose id is divisible by
    ``every``: negatives score ``low`` to ``high`` percent of the positive."""
    rows = quantised(frame.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").cast("long").alias("label")), key="key", vector="vector", keep=("label",))
    cells = _celled(rows)
    anchors = cells.where(F.pmod("id", F.lit(every)) == 0).select("row", "id", "length", "v", "norm", "label", "pivot", "reach")
    band = lambda no, lo, hi: F.struct(no.cast("int").alias("no"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    any_score = F.array(band(F.lit(0), F.lit(LOW), F.lit(HIGH)))
    found = shared.staged(neighbour_join(cells, anchors.withColumn("bands", any_score), k=positives, same=True), "positives")
    pairs = found.where("score >= 0").select("a_row", F.col("rank").alias("no"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The percentages of whole and last hundred apart, so that nothing overflows.
    share = lambda p, up: F.expr(f"(positive_score div 100) * {p} + ((positive_score % 100) * {p} + {99 if up else 0}) div 100")
    bands = pairs.groupBy("a_row").agg(F.collect_list(band(F.col("no"), share(low, True), share(high, False))).alias("bands"))
    asked = anchors.join(bands, F.col("row") == F.col("a_row")).drop("a_row")
    best = neighbour_join(cells, asked, k=negatives, same=False).withColumnsRenamed({"id": "negative_id", "score": "negative_score", "a_row": "anchor_row"})
    named = anchors.select(F.col("row").alias("n_row"), F.col("id").alias("anchor_id"))
    out = best.join(pairs.withColumnRenamed("no", "p_no"), (F.col("anchor_row") == F.col("a_row")) & (F.col("no") == F.col("p_no"))).join(named, F.col("anchor_row") == F.col("n_row"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("no").alias("positive_rank"), "anchor_row")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(rows.select("vec_id", "embedding", shifted.alias("label")))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
SQL = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, c.r AS other, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r AND len(a.v) = len(c.v)
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
}
