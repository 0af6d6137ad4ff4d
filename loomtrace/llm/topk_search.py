"""Exact inner-product top-k by ball-tree branch and bound in shards, with the k-th score shared between shards.

Vectors are dealt into shards of about ``SHARD_ROWS`` by direction: to the pivot, of at most ``PIVOTS`` ones, with the greatest
inner product, and by hash within a pivot that holds more. Each shard builds a ball tree. Every query
first searches the shard that it lies in itself; with its k-th score there it is held against the root balls of all
shards, and travels only to those whose bound reaches it. In a tree a query first goes down to its best leaf; then nodes
are taken from the root, a level at a time, subtrees whose bound (centre product plus radius times query norm) is below
the k-th score held are cut, and leaves are read in order of their bounds while these reach the current k-th score. A task
holds one shard and at most ``QUERY_ROWS`` queries.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do null ids; rows that
repeat an id are rows of their own, as queries and as candidates, and only the query's own row is no candidate of it; only
vectors of the query's own length have an inner product with it, 0 for empty ones; ties go to the smaller id; fewer candidates than k
give fewer rows; components of any finite size are multiplied exactly, and a score among the best that does not fit a
long raises; other columns are not read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS, PIVOTS = 4096, 2048, 64, 1024
#: Root balls that one task holds a block of queries against.
ROOT_ROWS = 4096
#: Inner products of floats are exact below this; beyond it whole numbers of any size are multiplied.
EXACT = 2.0**53
NONE = np.iinfo(np.int64).max


def dot(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows that hold whole numbers as floats; whole numbers of any size unless ``exact`` in floats."""
    if exact:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a) @ whole(b).T


class BallTree:
    """Rows of one shard and one vector length, parted between two rows far from each other down to leaves."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order, nodes = np.arange(len(ids)), []  # (from, to, left child), children side by side
        todo = [(0, len(ids))]
        for a, b in todo:  # grows: breadth first
            nodes.append((a, b, len(todo) if b - a > LEAF_ROWS else -1))
            if b - a > LEAF_ROWS:
                part = x[order[a:b]]
                one = part[np.argmax(((part - part.mean(axis=0)) ** 2).sum(axis=1))]
                two = part[np.argmax(((part - one) ** 2).sum(axis=1))]
                along = part @ (two - one)
                by = np.argsort(along, kind="stable")
                order[a:b] = order[a:b][by]
                # At a wide gap, else in the middle.
                edge = (b - a) // 16
                gaps = np.diff(along[by[edge : b - a - edge]])
                wide = int(np.argmax(gaps))
                half = a + (edge + wide + 1 if gaps[wide] > 0.2 * np.ptp(along) else (b - a) // 2)
                todo += [(a, half), (half, b)]
        self.row, self.ids, self.x = row[order], ids[order], x[order]
        self.begin, self.end, self.left = (np.array(c) for c in zip(*nodes))
        self.centre = np.array([self.x[a:b].mean(axis=0) for a, b, _ in nodes])
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1).max()) for (a, b, _), c in zip(nodes, self.centre)])
        self.longest = float(np.sqrt((self.x**2).sum(axis=1).max()))

    def bound(self, q: np.ndarray, norm: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Upper bounds of each query's products in its node; rounding never hides one."""
        reach = norm * self.radius[node]
        inner = np.einsum("ij,ij->i", q, self.centre[node])
        return inner + reach + 1e-9 * (1.0 + np.abs(inner) + reach + norm * np.linalg.norm(self.centre[node], axis=1))

    def search(self, qrow: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best (scores, ids) of each query, fewer marked by minus infinity; ``least``: a score that the k-th best of all
        shards is known to reach, so lower ones need not be found."""
        norm = np.sqrt((q**2).sum(axis=1))
        exact = bool(len(q)) and float(norm.max()) * self.longest < EXACT
        score = np.full((len(q), k), -np.inf, object if not exact else float)
        best = np.full((len(q), k), NONE)

        def read(some: np.ndarray, leaf: int) -> None:
            a, b = self.begin[leaf], self.end[leaf]
            s = dot(q[some], self.x[a:b], exact)
            s[self.row[a:b][None, :] == qrow[some][:, None]] = -np.inf
            all_s = np.concatenate([score[some], s], axis=1)
            all_i = np.concatenate([best[some], np.broadcast_to(self.ids[a:b], s.shape)], axis=1)
            if exact:
                top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            else:
                top = np.array([sorted(range(len(v)), key=lambda j: (-v[j], i[j]))[:k] for v, i in zip(all_s, all_i)])
            score[some], best[some] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)

        def kth(some: np.ndarray) -> np.ndarray:
            return np.maximum(score[some, k - 1].astype(float), least[some])

        def by_leaf(some: np.ndarray, leaf: np.ndarray) -> None:
            order = np.argsort(leaf, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                read(some[part], int(leaf[part[0]]))

        # Down to the child with the greater bound.
        every = np.arange(len(q))
        node = np.zeros(len(q), np.int64)
        while (inner := np.flatnonzero(self.left[node] >= 0)).size:
            child = self.left[node[inner]]
            node[inner] = child + (self.bound(q[inner], norm[inner], child + 1) > self.bound(q[inner], norm[inner], child))
        by_leaf(every, node)
        first = node
        # From the root, a level at a time; a subtree below the k-th score is cut.
        who, at = every, np.zeros(len(q), np.int64)
        leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            up = self.bound(q[who], norm[who], at)
            ok = up >= kth(who)
            who, at, up = who[ok], at[ok], up[ok]
            leaf = self.left[at] < 0
            fresh = leaf & (at != first[who])
            leaves.append((who[fresh], at[fresh], up[fresh]))
            who, child = who[~leaf], self.left[at[~leaf]]
            who, at = np.r_[who, who], np.r_[child, child + 1]
        who, at, up = (np.concatenate(c) for c in zip(*leaves))
        # Leaves in order of their bounds, one for each query a turn, while they reach the current k-th score.
        order = np.lexsort((-up, who))
        who, at, up = who[order], at[order], up[order]
        turn = np.arange(len(who)) - np.searchsorted(who, who, side="left")
        for r in range(int(turn.max(initial=-1)) + 1):
            now = np.flatnonzero(turn == r)
            now = now[up[now] >= kth(who[now])]
            if len(now):
                by_leaf(who[now], at[now])
        return score, best


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def quantised(frame: DataFrame, *, key: str, vector: str, scale: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, id, length, v, norm, keep...): floor(scale * x) of every component as double; no null or non-finite vectors. ``row`` names a
    row; an empty vector gets one component 0 beside its length 0, so that every vector has some."""
    x = F.col(vector).cast("array<double>")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = lambda c: c * F.lit(float(scale))
    # floor() gives a long, which may be too small; doubles of that size are whole.
    v = F.transform(x, lambda c: F.when(F.abs(scaled(c)) < EXACT, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    rows = frame.where(F.col(key).isNotNull() & fit).select(F.col(key).cast("long").alias("id"), F.size(x).alias("length"), F.when(F.size(x) > 0, v).otherwise(F.array(F.lit(0.0))).alias("v"), *keep)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    return shared.staged(rows.select(F.monotonically_increasing_id().alias("row"), "id", "length", "v", norm.alias("norm"), *keep), "vectors")


def _in_groups(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """The rows of a sorted partition, a value of ``column`` at a time."""
    kept: list[pd.DataFrame] = []
    for b in batches:
        ends = np.flatnonzero(np.diff(b[column].to_numpy())) + 1
        for part in np.split(np.arange(len(b)), ends):
            part = b.iloc[part]
            if kept and len(part) and kept[0][column].iloc[0] != part[column].iloc[0]:
                yield pd.concat(kept)
                kept = []
            kept.append(part)
    if kept and sum(map(len, kept)):
        yield pd.concat(kept)


def sharded(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with their shard: pivots are vectors of the table, at most ``PIVOTS`` by hash; shards of a pivot are as many as its
    rows need."""
    count = min(PIVOTS, max(1, -(-n // SHARD_ROWS)))
    pivots = [(r["length"], np.array(r["v"])) for r in rows.orderBy(F.xxhash64("row"), "row").limit(count).collect()]
    if count == 1:
        return rows.withColumn("shard", F.lit(0).cast("long"))
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, pivot = b["length"].to_numpy(), np.zeros(len(b), np.int64)
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                mine = [i for i, (n, _) in enumerate(held.value) if n == d]
                if mine:
                    p = np.array([held.value[i][1] for i in mine])
                    p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)
                    pivot[at] = np.array(mine)[np.argmax(_stack(b["v"].iloc[at]) @ p.T, axis=1)]
            yield b.assign(pivot=pivot)

    dealt = shared.staged(rows.mapInPandas(deal, "row long, id long, length int, v array<double>, norm double, pivot long"), "dealt")
    sizes = dealt.groupBy("pivot").agg(F.count("*").alias("held"))  # a row a pivot
    parts = dealt.join(F.broadcast(sizes), "pivot").withColumn("part", F.pmod(F.xxhash64("row"), F.greatest(F.ceil(F.col("held") / SHARD_ROWS), F.lit(1))))
    return shared.staged(parts.select("row", "id", "length", "v", "norm", (F.col("pivot") * (1 << 32) + F.col("part")).alias("shard")), "shards")


def top_k(frame: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all other rows."""
    rows = quantised(frame, key=key, vector=vector)
    rows = sharded(rows, rows.count())
    is_query = F.pmod("id", F.lit(every)) == 0
    found = "query_row long, query_id long, vec_id long, score long"

    def write(asked: pd.DataFrame, score: np.ndarray, best: np.ndarray) -> pd.DataFrame:
        ok = score.astype(float) > -np.inf
        times, scores = ok.sum(axis=1), score[ok]
        if scores.dtype == object:
            if any(abs(s) >= 1 << 63 for s in scores):
                raise OverflowError("a score does not fit a long")
            scores = np.array([int(s) for s in scores], np.int64)
        return pd.DataFrame({"query_row": np.repeat(asked["row"].to_numpy(), times), "query_id": np.repeat(asked["id"].to_numpy(), times), "vec_id": best[ok], "score": scores.astype(np.int64)})

    def trees(here: pd.DataFrame, asked: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for d in np.unique(asked["length"]):
            x, q = here[here["length"] == d], asked[asked["length"] == d]
            if len(x):
                tree = BallTree(x["row"].to_numpy(), x["id"].to_numpy(), _stack(x["v"]))
                for at in range(0, len(q), QUERY_ROWS):
                    some = q.iloc[at : at + QUERY_ROWS]
                    yield write(some, *tree.search(some["row"].to_numpy(), _stack(some["v"]), k, some["least"].to_numpy(float)))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _in_groups(batches, "shard"):
            yield from trees(cell, cell[cell["id"] % every == 0].assign(least=-np.inf))

    own = rows.repartition("shard").sortWithinPartitions("shard", "row").select("row", "id", "length", "v", "shard")
    result = shared.staged(own.mapInPandas(home, found), "home")
    shards = rows.select("shard").distinct().count()
    if shards > 1:
        result = result.unionByName(_elsewhere(rows, result, is_query, k, shards, trees, found))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return result.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _elsewhere(rows: DataFrame, home: DataFrame, is_query, k: int, shards: int, trees, found: str) -> DataFrame:
    """What queries find in shards other than their own, of those whose root ball reaches their k-th score."""
    kth = home.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
    asked = rows.where(is_query).join(kth, F.col("row") == F.col("query_row"), "left")
    asked = shared.staged(asked.select("row", "id", "length", "v", "shard", F.coalesce(F.col("s").cast("double"), F.lit(float("-inf"))).alias("least")), "asked")

    def ball(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _in_groups(batches, "shard"):
            for d, part in cell.groupby("length"):
                x = _stack(part["v"])
                centre = x.mean(axis=0)
                yield pd.DataFrame({"shard": [part["shard"].iloc[0]], "length": [d], "v": [centre.tolist()], "radius": [float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))]})

    balls = rows.select("shard", "length", "v").repartition("shard").sortWithinPartitions("shard").mapInPandas(ball, "shard long, length int, v array<double>, radius double")
    # Blocks of queries meet blocks of root balls: one ball for ``SHARD_ROWS`` vectors, so this grid is that much smaller than all pairs.
    roots, blocks = -(-shards // ROOT_ROWS), max(1, -(-asked.count() // QUERY_ROWS))
    cell = lambda root, block: (root * blocks + block).alias("cell")
    none = F.lit(0.0)
    left = asked.withColumn("root", F.explode(F.sequence(F.lit(0), F.lit(roots - 1)))).select(cell(F.col("root"), F.pmod(F.xxhash64("row"), F.lit(blocks))), F.lit(1).alias("kind"), "row", "length", "v", "shard", "least", none.alias("radius"))
    right = balls.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        cell(F.pmod(F.xxhash64("shard"), F.lit(roots)), F.col("block")), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("row"), "length", "v", "shard", none.alias("least"), "radius",
    )

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for both in _in_groups(batches, "cell"):
            for _, part in both.groupby("length"):
                b, q = part[part["kind"] == 0], part[part["kind"] == 1]
                if len(b) and len(q):
                    centre, x = _stack(b["v"]), _stack(q["v"])
                    norm, radius = np.linalg.norm(x, axis=1), b["radius"].to_numpy()
                    bound = x @ centre.T + norm[:, None] * radius[None, :]
                    bound += 1e-9 * (1.0 + np.abs(bound) + norm[:, None] * (radius + np.linalg.norm(centre, axis=1))[None, :])
                    i, j = np.nonzero((bound >= q["least"].to_numpy()[:, None]) & (q["shard"].to_numpy()[:, None] != b["shard"].to_numpy()[None, :]))
                    yield pd.DataFrame({"row": q["row"].to_numpy()[i], "to": b["shard"].to_numpy()[j]})

    grid = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "kind")
    sent = shared.staged(grid.mapInPandas(reach, "row long, to long"), "sent")
    # A shard that many queries go to is copied for each block of them.
    need = sent.groupBy("to").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks"))
    queries = sent.join(asked.drop("shard"), "row").join(need, "to").withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")))
    held = rows.join(need, F.col("shard") == F.col("to")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    name = F.concat_ws("/", "to", "block").alias("cell")
    both = held.select(name, F.lit(0).alias("kind"), "row", "id", "length", "v", none.alias("least")).unionByName(queries.select(name, F.lit(1).alias("kind"), "row", "id", "length", "v", "least"))

    def away(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _in_groups(_coded(batches), "code"):
            yield from trees(part[part["kind"] == 0], part[part["kind"] == 1])

    return both.repartition("cell").sortWithinPartitions("cell", "kind", "row").mapInPandas(away, found)


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted cells with a running number."""
    before, code = None, -1
    for b in batches:
        cells = b["cell"].to_numpy()
        if len(cells):
            new = np.r_[cells[0] != before, cells[1:] != cells[:-1]]
            codes = code + np.cumsum(new)
            before, code = cells[-1], int(codes[-1])
            yield b.assign(code=codes)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(shared.table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_topk_search": op1_topk_search}
SQL = {
    "op1_topk_search": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
), t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM t WHERE rank <= 5
""",
}
