"""Repeated substrings over a whole corpus: sharded enhanced suffix arrays and their common-prefix interval trees.

Every ``window`` bytes of a text contain an anchor: the 24-byte gram with the smallest hash, so equal windows have equal
anchors at equal places. A text is cut into contexts, the bytes of all windows that one anchor stands for. Only
anchors that occur more than once go on. Contexts that recur whole are repeated bytes, and one of them stands for all;
of an anchor with differing contexts each distinct one goes to the shard that the anchor's hash names, where a suffix
array over the shard's contexts is scanned for maximal repeats (see ``suffix_array``). Their occurrences and the recurring contexts
make up the repeated bytes.

Hot anchors, with more than ``SHARD_KINDS`` distinct contexts, are split by content instead: the windows of a context are halved by
their place, each half is keyed by the bytes that all its windows hold in common, equal halves collapse, and so on until a
key has few contexts or its contexts are one window. Nothing is dropped and no key gathers an unbounded group.

Equality of contexts before the suffix arrays is that of two 64-bit hashes, lengths and places. Rows of one text, told by its
SHA-256, go through all this once: from the window's length on each of them repeats the others whole.

Defined cases: null text counts as empty; texts shorter than the window have no repeats; repeated rows repeat each other, so
they lose everything from the window's length on; ids play no part, so null and repeated ones do no harm; a very long text is read
in stretches of ``STRETCH`` windows and never cut; matches never cross texts; an empty table gives an empty result. Columns
other than key and text are not read, unless ``keep`` asks for them; a kept one named like a column of the result raises.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .suffix_array import MAX_BYTES, maximal_repeats

GRAM = 24
#: Distinct contexts of one anchor that a shard takes at most.
SHARD_KINDS = 512
#: Window starts that are looked at together.
STRETCH = 1 << 19
_P, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


@cache
def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 1 << 64))


def anchors(text: bytes, window: int) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """(anchor, first window, last window) positions of a text, a stretch of windows at a time."""
    w = window - GRAM + 1
    for at in range(0, len(text) - window + 1, STRETCH):
        b = np.frombuffer(text[at : at + STRETCH + window - 1], np.uint8).astype(np.uint64)
        n = len(b)
        h, d = b, 1
        while d < 16:
            h, d = h[:-d] * _power(d) + h[d:], 2 * d
            eight = h if d == 8 else None if d < 8 else eight
        h = h[: n - GRAM + 1] * _power(8) + eight[16 : 16 + n - GRAM + 1]
        v = (h ^ (h >> np.uint64(29))) * _MIX
        v ^= v >> np.uint64(32)
        low = np.uint64((1 << 20) - 1)
        key = (v & ~low) | np.arange(len(v), dtype=np.uint64)  # the leftmost of equal grams
        m, s = key, 1
        while 2 * s <= w:
            m, s = np.minimum(m[:-s], m[s:]), 2 * s
        starts = len(key) - w + 1
        pos = (np.minimum(m[:starts], m[w - s : w - s + starts]) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
        last = np.r_[first[1:] - 1, starts - 1]
        yield (pos[first] + at).tolist(), (first + at).tolist(), (last + at).tolist()


def _distinct(docs: DataFrame, key: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """(id, digest, times, size, z, own): every distinct text once, compressed, under an id of its own; ``own`` holds key and
    kept columns of a text that stands in one row. Copies are combined before the shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = F.struct(F.col(key).alias("key"), *[F.col(f"`{n}`").alias(f"keep{i}") for i, n in enumerate(keep)])
    rows = docs.select(F.sha2(t, 256).alias("digest"), F.octet_length(t).cast("long").alias("size"), t.cast("binary").alias("z"), own.alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = pa.array([squeeze(t.as_buffer()) for t in b.column("z")], pa.binary())
            yield b.set_column(b.schema.get_field_index("z"), "z", z)

    packed = rows.mapInArrow(run, rows.schema)
    once = packed.groupBy("digest").agg(F.first("size").alias("size"), F.count("*").alias("times"), F.first("z").alias("z"), F.first("own").alias("own"))
    return shared.staged(once.withColumn("id", F.monotonically_increasing_id()), "texts")


def _settle(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what has been written, before the next large step."""
    gc.collect()
    spark._jvm.System.gc()


def _tell_apart(rows: DataFrame, covered: list[DataFrame], limit: int) -> tuple[DataFrame, DataFrame]:
    """Collapse equal contexts of (key, ctx, lo, hi) rows. All members of a context that recurs are covered; returns what
    is left of keys with up to ``limit`` kinds, and of keys with more."""
    spark = rows.sparkSession
    same = ["key", "lo", "hi", "ch"]
    rows = shared.staged(rows.withColumn("ch", F.xxhash64("ctx")), "halves")
    place = [F.first(c).alias(c) for c in ("ctx", "x", "y")]
    kinds = shared.staged(rows.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("id", "a")).alias("rep"), *place), "kinds")
    again = kinds.where("n > 1").select(*[F.col(c).alias("k_" + c) for c in same])
    on = F.lit(True)
    for c in same:
        on = on & (F.col(c) == F.col("k_" + c))
    span = [(F.col("a") + F.col("lo")).alias("start"), (F.col("a") + F.col("hi") + F.col("window")).alias("end")]
    covered.append(shared.staged(rows.drop("ctx").join(again, on).select("id", *span), "covered"))
    many = shared.staged(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumnRenamed("key", "k_key"), "many")
    left = kinds.join(many, F.col("key") == F.col("k_key")).select("key", "lo", "hi", "ctx", "x", "y", "kinds", "rep.id", "rep.a")
    left = shared.staged(left, "left")
    shared.drop_staged(rows)
    shared.drop_staged(kinds)
    _settle(spark)
    return left.where(F.col("kinds") <= limit).drop("kinds"), left.where(F.col("kinds") > limit).drop("kinds")


def _half(hot: DataFrame, x: Column, y: Column, window: int) -> DataFrame:
    """Contexts cut to the windows that begin x to y bytes from their anchor, keyed by the bytes that all those hold."""
    part = hot.withColumn("nx", x).withColumn("ny", y).where("nx <= ny and lo <= ny and hi >= nx")
    core = F.substring(F.col("ctx"), F.col("ny") - F.col("lo") + 1, F.col("nx") + window - F.col("ny"))
    lo, hi = F.greatest(F.col("lo").cast("int"), "nx"), F.least(F.col("hi").cast("int"), "ny")
    return part.select(
        F.xxhash64("key", "nx", "ny", core).alias("key"), lo.cast("short").alias("lo"), hi.cast("short").alias("hi"),
        F.substring(F.col("ctx"), lo - F.col("lo") + 1, hi - lo + window).alias("ctx"), "id", "a", F.col("nx").alias("x"), F.col("ny").alias("y"), F.lit(window).alias("window"),
    )


def repeated_spans(texts: DataFrame, *, window: int = 200, shard_kinds: int = SHARD_KINDS) -> DataFrame:
    """(id, spans): the repeated bytes of each of the distinct texts (id, z, size) that has any, as [start, end) pairs in no
    order, possibly overlapping."""
    import xxhash

    if window <= GRAM or 2 * window * shard_kinds > MAX_BYTES:
        raise ValueError(f"the window must exceed {GRAM} bytes, and a shard's contexts must fit {MAX_BYTES} bytes")
    spark = texts.sparkSession
    long_enough = texts.where(F.col("size") >= window).select("id", "z")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        digest, spread = xxhash.xxh64_intdigest, zstandard.ZstdDecompressor().decompress
        shared.claim("suffix_dedup")
        for batch in batches:
            for at in range(0, len(batch), 1024):
                b = batch.iloc[at : at + 1024]
                h, c, own, a_, lo, hi = [], [], [], [], [], []
                for i_, z in zip(b["id"], b["z"]):
                    body = spread(z)
                    for pos, first, last in anchors(body, window):
                        h += [digest(body[p : p + GRAM]) for p in pos]
                        c += [digest(body[i : j + window], p - i) for p, i, j in zip(pos, first, last)]
                        a_ += pos
                        lo += [i - p for p, i in zip(pos, first)]
                        hi += [j - p for p, j in zip(pos, last)]
                        own += [i_] * len(pos)
                yield pd.DataFrame({"key": np.array(h, np.uint64).view(np.int64), "ch": np.array(c, np.uint64).view(np.int64), "id": own, "a": a_, "lo": lo, "hi": hi})

    found = shared.staged(long_enough.mapInPandas(find, "key long, ch long, id long, a int, lo short, hi short"), "anchors")
    # Written first: as a table of its own it is dealt anew for the join, so the join can split a frequent key.
    twice = shared.staged(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k_key")), "twice")
    shared_anchors = shared.staged(found.join(twice, F.col("key") == F.col("k_key")).drop("k_key"), "candidates")
    shared.drop_staged(found)
    _settle(spark)

    # Contexts are still told by their hashes here; no text has moved.
    same = ["key", "ch", "lo", "hi"]
    kinds = shared.staged(shared_anchors.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("id", "a")).alias("rep")), "kinds")
    again = kinds.where("n > 1").select(*[F.col(c).alias("k_" + c) for c in same])
    on = F.lit(True)
    for c in same:
        on = on & (F.col(c) == F.col("k_" + c))
    span = [(F.col("a") + F.col("lo")).alias("start"), (F.col("a") + F.col("hi") + window).alias("end")]
    covered = [shared.staged(shared_anchors.join(again, on).select("id", *span), "covered")]
    many = shared.staged(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumnRenamed("key", "k_key"), "many")
    wanted = kinds.join(many, F.col("key") == F.col("k_key")).select("key", "lo", "hi", "kinds", "rep.id", "rep.a")
    wanted = shared.staged(wanted, "wanted")
    shared.drop_staged(shared_anchors)
    _settle(spark)

    # Fetch those contexts from the texts; a text is there once, so a context is, too.
    asked = wanted.groupBy("id").agg(F.collect_list(F.struct("key", "lo", "hi", "kinds", "a")).alias("asked"))
    asked = asked.select(F.col("id").alias("w_id"), *[F.col(f"asked.{c}").alias(n) for c, n in zip(("key", "lo", "hi", "kinds", "a"), "klhnp")])

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        spread = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for at in range(0, len(b), 256):
                out = []
                for d, z, k, l, h, n, p in b.iloc[at : at + 256][["id", "z", "k", "l", "h", "n", "p"]].itertuples(index=False, name=None):  # noqa: E741
                    body = spread(z)
                    out += [(k[i], l[i], h[i], body[p[i] + l[i] : p[i] + h[i] + window], n[i], d, p[i]) for i in range(len(k))]
                yield pd.DataFrame(out, columns=["key", "lo", "hi", "ctx", "kinds", "id", "a"])

    fetched = long_enough.join(asked, F.col("id") == F.col("w_id")).drop("w_id").mapInPandas(fetch, "key long, lo short, hi short, ctx binary, kinds long, id long, a int")
    contexts = shared.staged(fetched, "contexts")
    shared.drop_staged(wanted)
    _settle(spark)

    cool, hot = contexts.where(F.col("kinds") <= shard_kinds).drop("kinds"), contexts.where(F.col("kinds") > shard_kinds).drop("kinds")
    shards = [cool]
    hot = hot.withColumn("x", F.lit(-(window - GRAM))).withColumn("y", F.lit(0))
    width = window - GRAM
    while width > 0 and not hot.isEmpty():
        # Halve the windows' places [x, y]; a half is keyed by the bytes that all its windows hold.
        mid = F.floor((F.col("x") + F.col("y")) / 2).cast("int")
        part = _half(hot, F.col("x"), mid, window).unionByName(_half(hot, mid + 1, F.col("y"), window))
        few, hot = _tell_apart(part, covered, shard_kinds)
        shards.append(few)
        width //= 2

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        size = 0

        def repeats(some: pd.DataFrame) -> Iterator[pd.DataFrame]:
            body = [bytes(c) for c in some["ctx"]]
            cuts, total = [0], 0
            ks = some["key"].to_numpy()
            edge = np.flatnonzero(np.r_[ks[1:] != ks[:-1], True]) + 1  # contexts of one key stay together
            for e, s in zip(edge.tolist(), np.add.reduceat(np.array([len(c) for c in body]), np.r_[0, edge[:-1]]).tolist()):
                if total and total + s > MAX_BYTES:
                    cuts.append(prev)
                    total = 0
                total, prev = total + s, e
            cuts.append(len(body))
            start0 = (some["a"].to_numpy(np.int64) + some["lo"].to_numpy(np.int64))
            for x, y in zip(cuts, cuts[1:]):
                part = body[x:y]
                lengths = np.array([len(c) for c in part])
                who, begin, end = [], [], []
                for length, owner, offset in maximal_repeats(part, window, depth=max(640, 2 * window)):
                    room = lengths[owner] - offset
                    top = np.partition(room, -2)[-2:]
                    partner = np.where(room == top[1], top[0], top[1])  # the longest room among the others
                    who.append(owner)
                    begin.append(offset)
                    end.append(offset + np.minimum(np.minimum(length, room), partner))
                if who:
                    who, begin, end = map(np.concatenate, (who, begin, end))
                    order = np.lexsort((begin, who))
                    who, begin, end = who[order], begin[order], end[order]
                    # Join overlapping occurrences of one context.
                    reach = np.maximum.accumulate(end + who * (1 << 20))
                    fresh = np.r_[True, begin[1:] + who[1:] * (1 << 20) > reach[:-1]]
                    at = np.flatnonzero(fresh)
                    stop = (reach - who * (1 << 20))[np.r_[at[1:] - 1, len(who) - 1]]
                    rows = some.iloc[x + who[at]]
                    yield pd.DataFrame({"id": rows["id"].to_numpy(), "start": start0[x + who[at]] + begin[at], "end": start0[x + who[at]] + stop})

        for b in batches:
            kept.append(b)
            size += sum(map(len, b["ctx"]))
            if size > 4 * MAX_BYTES and kept[0]["key"].iloc[0] != b["key"].iloc[-1]:
                some = pd.concat(kept)
                last = (some["key"] == some["key"].iloc[-1]).to_numpy()
                yield from repeats(some[~last])
                kept = [some[last]]
                size = sum(map(len, kept[0]["ctx"]))
        if kept and sum(map(len, kept)):
            yield from repeats(pd.concat(kept))

    columns = ["key", "lo", "ctx", "id", "a"]
    every = shards[0].select(*columns)
    for s in shards[1:]:
        every = every.unionByName(s.select(*columns))
    spread_out = every.repartition("key").sortWithinPartitions("key", "id", "a")
    covered.append(shared.staged(spread_out.mapInPandas(scan, "id long, start int, end int"), "covered"))
    shared.drop_staged(contexts)
    _settle(spark)
    out = covered[0]
    for c in covered[1:]:
        out = out.unionByName(c)
    return out.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    at = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
    return s[at], reach[np.r_[at[1:] - 1, len(s) - 1]]


def remove_repeats(
    docs: DataFrame, *, window: int = 200, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), as_text: bool = False, shard_kinds: int = SHARD_KINDS
) -> DataFrame:
    """(key, kept, n_bytes, n_removed, n_spans, keep...): the bytes of every row that no repeat covers. ``as_text`` gives
    them as a string, without the bytes of characters that a cut has split. ``keep`` must not name one of the first five."""
    out_names = (key, "kept", "n_bytes", "n_removed", "n_spans")
    if len({n.lower() for n in (*out_names, *keep)}) < 5 + len(keep):
        raise ValueError("keep repeats the name of a column of the result")
    texts = _distinct(docs, key, text, keep)
    spans = repeated_spans(texts, window=window, shard_kinds=shard_kinds)
    spans = spans.select(F.col("id").alias("s_id"), F.col("spans.start").alias("s"), F.col("spans.end").alias("e"))
    alone = texts.where("times = 1").select("id", "z", "own").join(spans, F.col("id") == F.col("s_id"), "left").select("own", "z", "s", "e")
    body = pa.string() if as_text else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        spread = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                kept, size, removed, runs = [], [], [], []
                for z, s, e in zip(part.column("z"), part.column("s"), part.column("e")):
                    whole = left = spread(z.as_buffer())
                    n = 0
                    if s.is_valid:
                        x, y = _joined(s.values.to_numpy().astype(np.int64), e.values.to_numpy().astype(np.int64))
                        edges = [0, *np.column_stack([x, y]).ravel().tolist(), len(whole)]
                        left, n = b"".join(whole[i:j] for i, j in zip(edges[::2], edges[1::2])), len(x)
                    size.append(len(whole))
                    removed.append(len(whole) - len(left))
                    runs.append(n)
                    kept.append(left.decode("utf-8", "ignore") if as_text else left)
                columns = [part.column("own"), pa.array(kept, body), *(pa.array(c, pa.int64()) for c in (size, removed, runs))]
                yield pa.RecordBatch.from_arrays(columns, ["own", *out_names[1:]])

    own_kind = alone.schema["own"].dataType.simpleString()
    single = alone.mapInArrow(run, f"own {own_kind}, kept {body}, n_bytes long, n_removed long, n_spans long")
    single = single.select(F.col("own.key").alias(key), *out_names[1:], *[F.col(f"own.keep{i}").alias(n) for i, n in enumerate(keep)])
    # A text of several rows repeats as a whole from the window's length on; a shorter one has no repeats.
    copies = texts.where("times > 1").select(F.col("digest").alias("c_digest"))
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(t).cast("long")
    whole = size >= window
    rest = F.when(whole, "").otherwise(t)
    rows = docs.select(
        F.sha2(t, 256).alias("_digest"), F.col(key).alias(key), (rest if as_text else rest.cast("binary")).alias("kept"), size.alias("n_bytes"), F.when(whole, size).otherwise(0).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(0).cast("long").alias("n_spans"), *[F.col(f"`{n}`") for n in keep],
    )
    several = rows.join(copies, F.col("_digest") == F.col("c_digest"), "left_semi").drop("_digest")
    return single.unionByName(several)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(shared.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
SQL: dict[str, str] = {}
