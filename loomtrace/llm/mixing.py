"""Mixing sources to target weights by the cube method.

Every document of a source gets the whole part of ``target / source size`` as copies; the fraction left is an inclusion
probability. The flight phase moves the probabilities along vectors that keep both their sum (documents) and their
size-weighted sum (words), until one of them is 0 or 1; it runs in blocks of about ``BLOCK`` rows, so a source of any
size is spread over many tasks, each of which leaves three undecided rows. Those meet in further rounds, and at
last the landing of the few rows of each source is solved by trying all roundings. Larger documents are decided first,
so that what is rounded at the end is small.

Rows alike in key, source and size travel as one with their number, and share out what it gets, so one row repeated a million
times is decided at once and lies in no overfull block.

Defined cases: null text has size 0; a source of size 0 has target 0; null is a source of its own, the last; rows that
repeat are documents of their own, also under null keys; ties in size go by hash; a very long text is one row like any other,
never taken more than ``most`` times; an empty table gives an empty result. Randomness comes from hashes of the rows, so
reruns agree. Columns other than key, source and text are not read, unless ``keep`` asks for them; a kept one named like a
column of the result raises.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Rows of a block of the flight phase.
BLOCK = 1024
#: Rows of a source that the landing rounds by trying all roundings.
LANDING = 12
#: Source totals are broadcast up to so many sources; beyond it they are joined by a shuffle.
FEW_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: random.Random, leave: int) -> np.ndarray:
    """Move probabilities to 0 or 1 keeping their sum and their size-weighted sum, until ``leave`` rows are between.

    Rows are decided in order. The vector of a move has 1 for the row in turn and ``a + b * size`` for all others
    that are still between, with a and b such that it lies in the null space of both constraints; the step goes to the
    border one way or the other, at odds that keep every expectation."""
    p = p.copy()
    between = (p > EPS) & (p < 1 - EPS)
    for k in range(len(p)):
        while between[k]:
            rest = np.flatnonzero(between)
            if len(rest) <= leave:
                return p
            rest = rest[rest != k]
            s = size[rest]
            n, s1, s2 = len(s), s.sum(), (s * s).sum()
            det = n * s2 - s1 * s1
            if det > EPS * n * max(s2, 1.0):
                a, b = (size[k] * s1 - s2) / det, (s1 - n * size[k]) / det
            elif s1 > 0:  # others of one size: words count first
                a, b = -size[k] / s1, 0.0
            else:
                a, b = -1.0 / n, 0.0
            at, u = np.append(rest, k), np.append(a + b * s, 1.0)
            q = p[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
                down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
            q = q + (up if rng.random() * (up + down) < down else -down) * u
            q = np.where(q <= EPS, 0.0, np.where(q >= 1 - EPS, 1.0, q))
            p[at] = q
            between[at] = (q > 0) & (q < 1)
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round what is left so that words, then documents, come nearest to their expectation: all roundings are tried."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    words, count = np.abs(choices @ size[left] - p[left] @ size[left]), np.abs(choices.sum(axis=1) - p[left].sum())
    p[left] = choices[np.lexsort((count, np.round(words, 6)))[0]]
    return p


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, rows, target) of rows (source, size, n): shares by weight of all words, stopped at ``most`` times the source's size, the
    excess dealt out again by weight until no target is above. In closed form: sources in the order of the share at
    which they stop; the level is that of the first source that need not stop."""
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("place", rank).withColumn("weight", weight).withColumn("stop", most * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("stop", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("level", (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min_by(F.when(F.col("stop") >= F.col("level"), F.col("level")), F.when(F.col("stop") >= F.col("level"), F.struct("stop", "place"))).over(everything)
    stop = F.col("source_size") * most
    return ranked.withColumn("l", F.coalesce(level, F.lit(0.0))).select("source", "source_size", "rows", F.least(F.col("weight") * F.col("l"), stop).cast("double").alias("target"))


#: A row that stands for more rows alike than this is spread over several tasks when they are told apart again.
ALIKE = 4096


def taken_copies(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, source, size, own, n, source_size, target, copies): rows alike in key, source, size and kept columns as one, with
    their number ``n`` and the copies that the mix takes of all of them. ``own`` holds the kept columns as keep0 and so on."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.struct(F.lit(0).alias("none"), *[F.col(f"`{n}`").alias(f"keep{i}") for i, n in enumerate(keep)])
    each = docs.select(F.col(key).alias("doc"), F.col(source).alias("source"), size.alias("size"), own.alias("own"))
    sizes = shared.staged(each.groupBy("doc", "source", "size", "own").agg(F.count("*").alias("n")), "sizes")
    targets = shared.staged(source_targets(sizes, weights, most), "targets")
    n_sources, largest = targets.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    right = targets.withColumnRenamed("source", "s")
    right = F.broadcast(right) if n_sources <= FEW_SOURCES else right
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0) * F.col("n")
    near = F.when(F.abs(ratio - F.round(ratio)) < EPS, F.round(ratio)).otherwise(ratio)
    rows = (
        sizes.join(right, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("ratio", near).withColumn("base", F.floor("ratio")).withColumn("p", F.col("ratio") - F.floor("ratio"))
        .withColumn("h", F.xxhash64("doc", "source", "size", "own", F.lit(seed))).drop("ratio")
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    plain = [f.name for f in rows.schema if f.name != "own"]

    def decide(last: bool):
        def run(part: pa.Table) -> pa.Table:
            size, h, p = (part.column(c).to_numpy() for c in ("size", "h", "p"))
            order = np.lexsort((h, -size))
            rng = random.Random(int(h[order[0]]) ^ len(h))
            decided = flight(p[order].astype(float), size[order].astype(float), rng, LANDING if last else 3)
            decided = landing(decided, size[order].astype(float)) if last else decided
            out = np.empty(len(h))
            out[order] = decided
            at = part.schema.get_field_index("p")
            return part.set_column(at, "p", pa.array(out)).select([*plain, "own"]).select(names)

        return run

    names = [f.name for f in rows.schema]
    done, turn = [rows.where("p <= 0 or p >= 1")], 0
    left = rows.where("p > 0 and p < 1")
    while True:
        last = largest <= BLOCK
        blocks = F.lit(1) if last else F.greatest(F.ceil(F.col("rows") * (3 / BLOCK) ** turn / BLOCK), F.lit(1))
        dealt = left.withColumn("block", F.pmod(F.xxhash64("h", F.lit(turn)), blocks).cast("long"))
        after = shared.staged(dealt.groupBy("source", "block").applyInArrow(decide(last), fields), "decided")
        done.append(after.where("p <= 0 or p >= 1"))
        if last:
            break
        left, turn, largest = after.where("p > 0 and p < 1"), turn + 1, 3 * -(-largest // BLOCK)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc", "source", "size", "own", "n", "source_size", "target", (F.col("base") + F.col("p")).cast("long").alias("copies"))


def mix(docs: DataFrame, *, key: str = "doc_id", keep: tuple[str, ...] = (), **how: object) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken, keep...) for every row; ``how`` as in :func:`taken_copies`.

    Rows alike share out their copies evenly, so none of them is taken more often than the limit."""
    if len({n.lower() for n in (key, "source", "size", "source_size", "target", "copies", "taken", *keep)}) < 7 + len(keep):
        raise ValueError("keep repeats the name of a column of the result")
    groups = taken_copies(docs, key=key, keep=keep, **how)
    # Row k of n alike gets the whole copies that fall between k / n and (k + 1) / n of theirs.
    many = groups.where("n > 1").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ALIKE).cast("long"))))
    many = many.repartition("doc", "source", "size", "own", "from").withColumn("k", F.explode(F.sequence("from", F.least(F.col("from") + ALIKE, F.col("n")) - 1)))
    share = lambda k: F.floor((k * F.col("copies")) / F.col("n"))
    rows = groups.where("n = 1").unionByName(many.withColumn("copies", share(F.col("k") + 1) - share(F.col("k"))).drop("from", "k"))
    kept = [F.col(f"own.keep{i}").alias(n) for i, n in enumerate(keep)]
    return rows.select(F.col("doc").alias(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *kept)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.table(spark, sf_dir, "documents")).drop("source")


QUERIES = {"op8_mixing": op8_mixing}
SQL: dict[str, str] = {}
