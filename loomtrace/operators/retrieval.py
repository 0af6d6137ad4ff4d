"""Vector search with penalties, diversified search, full-text ranking, incremental indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .validation import require_empty

#: One task holds queries and index vectors of so many bytes.
QUERY_BYTES, INDEX_BYTES = 8 << 20, 16 << 20
#: Tasks that a search is spread over, unless that makes an index part smaller than so many bytes.
SPREAD, LEAST_BYTES = 32, 1 << 20
#: Products that a task holds at once (4 bytes each).
CELLS = 1 << 20
#: Products of which first the greatest is taken.
RUN = 64


def matrix_of(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long vectors, without an object for each number."""
    flat = pc.list_flatten(vectors).to_numpy()
    if len(flat) != len(vectors) * pc.list_value_length(vectors[:1])[0].as_py() or vectors.null_count:
        return np.stack([np.asarray(v) for v in vectors.to_pylist()])  # raises where lengths differ
    return flat.reshape(len(vectors), -1)


def _near(a: np.ndarray, b: np.ndarray, penalty: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For every row of ``a`` the rows of ``b`` that can be among its k best by cosine less penalty: all but those that products in single
    precision exclude by more than their error. ``b`` is in the order of ids, so a row without direction has its first k."""
    la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for length in (la, lb, penalty):
        if not np.all((length == 0) | ((length > 1e-150) & (length < 1e150))):  # no number, or products that underflow
            yield from (np.arange(len(b)) for _ in a)
            return
    unit = lambda v, n: np.divide(v, n[:, None], out=np.zeros(v.shape, np.float32), where=n[:, None] > 0, casting="same_kind")
    ub, less = unit(b, lb), np.where(lb > 0, penalty, np.inf).astype(np.float32)
    error = (a.shape[1] + 8) * 2.0**-22 * (1 + penalty.max())
    whole = len(b) // RUN * RUN
    for at in range(0, len(a), max(1, CELLS // len(b))):
        some = slice(at, at + max(1, CELLS // len(b)))
        score = unit(a[some], la[some]) @ ub.T
        score -= less
        # The k-th best of the runs' greatest scores is no better than the k-th best score.
        tops = score[:, :whole].reshape(len(score), -1, RUN).max(axis=2) if whole >= k * RUN else score
        least = np.partition(tops, -k, axis=1)[:, -k].astype(float) - error if k <= tops.shape[1] else np.full(len(score), -np.inf)
        for row, lower, length in zip(score, least, la[some]):
            yield np.flatnonzero(row >= np.float32(lower)) if length else np.arange(min(k, len(b)))


def search(queries: DataFrame, index: DataFrame, k: int, *, penalties: DataFrame | None = None) -> DataFrame:
    """(query_id, skill_id, rank, score, cosine): top k by cosine less penalty, then cosine, then id. ``score`` ranks; the match keeps its plain cosine.

    queries: query_id, vector; index: skill_id, vector. Blocks of both form a grid of matrix products, each of which keeps its own top
    k. A negative penalty and one of an unknown id raise."""
    x = index.select("skill_id", F.col("vector").cast("array<double>").alias("v"))
    if penalties is not None:
        known = penalties.join(index.select("skill_id", F.lit(True).alias("known")).distinct(), "skill_id", "left")
        require_empty(known.where(F.col("known").isNull() | (F.col("penalty") < 0)), "penalties of unknown ids, or negative ones")
        x = x.join(penalties.select("skill_id", "penalty"), "skill_id", "left")
    else:
        x = x.withColumn("penalty", F.lit(0.0))
    size, asked = (rows.agg(F.coalesce(F.sum(F.size("vector") * 8), F.lit(0))).first()[0] for rows in (index, queries))
    blocks = max(1, -(-asked // QUERY_BYTES))
    parts = max(1, -(-size // INDEX_BYTES), min(-(-SPREAD // blocks), size // LEAST_BYTES))
    deal = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m))
    cell = lambda part, block: (part * blocks + block).alias("cell")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    kinds = {"q": queries.schema["query_id"].dataType, "s": index.schema["skill_id"].dataType}
    none = lambda kind: F.lit(None).cast(kind)
    left = queries.withColumn("o", every(parts)).select(cell(F.col("o"), deal("query_id", blocks)), F.col("query_id").alias("q"), none(kinds["s"]).alias("s"), F.col("vector").cast("array<double>").alias("v"), F.lit(0.0).alias("penalty"))
    right = x.withColumn("o", every(blocks)).select(cell(deal("skill_id", parts), F.col("o")), none(kinds["q"]).alias("q"), F.col("skill_id").alias("s"), "v", F.coalesce("penalty", F.lit(0.0)).alias("penalty"))
    q_kind, s_kind = (kinds[c].simpleString() for c in "qs")

    def near(part: pa.Table) -> pa.Table:
        is_query = pc.is_valid(part.column("q"))
        q, x = part.filter(is_query), part.filter(pc.invert(is_query))
        empty = pa.table({"q": q.column("q").slice(0, 0), "s": x.column("s").slice(0, 0), "cosine": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        if not len(q) or not len(x):
            return empty
        x = x.take(pc.sort_indices(x, [("s", "ascending")]))
        a, b = matrix_of(q.column("v")), matrix_of(x.column("v"))
        penalty, lengths, norms = x.column("penalty").to_numpy(), np.linalg.norm(b, axis=1), np.linalg.norm(a, axis=1)
        kept = []
        for i, near in enumerate(_near(a, b, penalty, k)):
            norm = norms[i] * lengths[near]
            c = np.divide(b[near] @ a[i], norm, out=np.full(len(near), -np.inf), where=norm > 0)
            score = np.round(c - penalty[near], 12)
            best = np.lexsort((-np.round(c, 12), -score))[:k]  # copies stay in the order of their ids
            kept.append((np.full(len(best), i), near[best], c[best], score[best]))
        who, top, cosine, score = (np.concatenate(c) for c in zip(*kept))
        return pa.table({"q": q.column("q").take(pa.array(who)), "s": x.column("s").take(pa.array(top)), "cosine": cosine, "score": score})

    found = left.unionByName(right).groupBy("cell").applyInArrow(near, f"q {q_kind}, s {s_kind}, cosine double, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.desc(F.round("cosine", 12)), "s")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("s").alias("skill_id"), "rank", "score", "cosine")


def thresholded(found: DataFrame, least: float) -> DataFrame:
    """Matches of at least this cosine; the filter comes after the limit, so fewer may be left."""
    return found.where(F.col("cosine") >= least)


def first_per(found: DataFrame, parent: str, step: str, name: str) -> DataFrame:
    """Of matches of several steps the first of each name, in the order of step and rank."""
    w = Window.partitionBy(parent, name).orderBy(step, "rank")
    kept = found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(parent).orderBy(step, "rank", name)))


def diverse(found: DataFrame, index: DataFrame, *, least: float, margin: float, same: float, relevance: float, most: int, penalties: DataFrame | None = None) -> DataFrame:
    """(query_id, place, skill_id): candidates within the threshold and the margin to the best, greedy removal of near
    copies of a kept one, then greedy maximal marginal relevance. A query's candidates are few: one group each."""
    best = found.groupBy("query_id").agg(F.max("cosine").alias("best"))
    kept = found.join(best, "query_id").where((F.col("cosine") >= least) & (F.col("cosine") >= F.col("best") - margin))
    kept = kept.join(index.select("skill_id", "vector"), "skill_id")
    kept = kept.join(penalties, "skill_id", "left") if penalties is not None else kept.withColumn("penalty", F.lit(0.0))
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        v = np.stack(part["vector"].to_numpy())
        n = np.linalg.norm(v, axis=1)
        scale = np.outer(n, n)
        c = np.divide(v @ v.T, scale, out=np.full(scale.shape, -1.0), where=scale > 0)
        alone: list[int] = []
        for i in range(len(part)):
            if all(c[i, j] <= same for j in alone):
                alone.append(i)
        cos, pen, ids = part["cosine"].to_numpy(), part["penalty"].fillna(0.0).to_numpy(), part["skill_id"].to_numpy()
        chosen: list[int] = []
        while alone and len(chosen) < most:
            worth = {i: relevance * cos[i] - (1 - relevance) * max((c[i, j] for j in chosen), default=0.0) - pen[i] for i in alone}
            pick = min(alone, key=lambda i: (-worth[i], -cos[i], ids[i]))
            chosen.append(pick)
            alone.remove(pick)
        return pd.DataFrame({"query_id": part["query_id"].iloc[0], "place": range(1, len(chosen) + 1), "skill_id": ids[chosen]})

    return kept.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, place int, skill_id {kinds['skill_id']}")


def postings(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings(key, term, tf), lengths(key, dl), frequencies(term, df))."""
    t = docs.select(key, F.explode(tx.terms(F.col(text))).alias("term"))
    p = t.groupBy(key, "term").agg(F.count("*").alias("tf"))
    return p, p.groupBy(key).agg(F.sum("tf").alias("dl")), p.groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, *, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc, rank, score): OR query over distinct terms; idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. Parts are rounded
    to nine digits and summed as decimals. ``textindex`` has the stemmed and pruned form."""
    p, lengths, df = postings(docs, key, text)
    stats = lengths.agg(F.avg("dl").alias("mean"))
    n = docs.agg(F.count("*").alias("n_docs"))
    q = queries.select("query_id", F.explode(F.array_distinct(tx.terms(F.col("query")))).alias("term"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighed = q.join(df, "term").crossJoin(n).select("query_id", "term", idf.alias("idf"))  # one row
    hits = p.join(weighed, "term").join(lengths, key).crossJoin(stats)  # one row
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    s = hits.groupBy("query_id", F.col(key).alias("doc")).agg(F.round(F.sum(F.round(part, 9).cast("decimal(24,9)")), 6).cast("double").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distinct_first(ranked: DataFrame, group: Column, most: int) -> DataFrame:
    """Of ranked rows the first of each group, then the first ``most`` of a query."""
    g = ranked.withColumn("_g", group)
    kept = g.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_g").orderBy("rank"))).where("_n = 1").drop("_n", "_g")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= most)


def pending_batches(texts: DataFrame, cache: DataFrame, size: int, *, text: str = "text") -> DataFrame:
    """(content_hash, batch): distinct texts that the cache does not hold, in batches of ``size`` by hash order within buckets of the hash's first digits."""
    h = texts.select(F.sha2(text, 256).alias("content_hash")).distinct().join(cache.select("content_hash"), "content_hash", "left_anti")
    bucket = F.substring("content_hash", 1, 1)
    n = F.row_number().over(Window.partitionBy(bucket).orderBy("content_hash")) - 1
    return h.select("content_hash", F.concat(bucket, F.lit("-"), F.floor(n / size).cast("string")).alias("batch"))


def reused(cards: DataFrame, index: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Cards with a vector from the index (same id and text hash), else from a checkpoint by hash, else null."""
    i = index.select("skill_id", "text_hash", F.col("vector").alias("vi"))
    c = checkpoint.groupBy("text_hash").agg(F.min("vector").alias("vc"))
    j = cards.join(i, ["skill_id", "text_hash"], "left").join(c, "text_hash", "left")
    origin = F.when(F.col("vi").isNotNull(), "index").when(F.col("vc").isNotNull(), "checkpoint")
    return j.select("skill_id", "text_hash", F.coalesce("vi", "vc").alias("vector"), origin.alias("origin"))
