"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``radius`` bits (four, unless told otherwise) share a value that is within
half the radius of either. Every distinct fingerprint stands for all its variants within two bits; variants are shuffled by
their first ``b`` bits, so a fingerprint travels once for each of the ``1 + b + b(b-1)/2`` heads that its variants have,
and the rest of a variant is made where the rows of a head meet. Fingerprints that meet in a variant differ in at most
four bits (two on either side), and each link is verified. ``b`` follows from the number of distinct fingerprints so that a
head keeps about ``HEAD_ROWS`` rows at any size; heads that are fuller by far are counted beforehand and dealt by further
bits. Copies share one fingerprint and are grouped before anything is emitted; a task makes a bounded number of variants at
once and merges meetings as it finds them, so a dense group of n fingerprints gives under n links for each head, not n squared.

A wider radius costs more: 2,081 variants a fingerprint at four, 43,745 at six.

Defined cases: null text counts as empty; no word gives fingerprint zero; fewer words than a shingle give one
shingle of the whole sequence; a very long text is hashed whole, one bit count per 65,536 shingles; repeated rows and rows of
a repeated or null key share a fingerprint if their texts do, and the smallest key that is not null names a component (null if
all are); an empty table gives an empty result. Other columns are not read, unless ``keep`` asks for them; a kept one named
like a column of the result raises.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import component_labels
from . import shared

HEAD_ROWS = 4096
#: Variants that a task makes at once (8 bytes each, and some ten times that while they are compared).
AT_ONCE = 1 << 21
#: Variants of a head's rows beyond which the shuffle deals them by four more bits.
FULL_HEAD = 1 << 23
#: A component's smallest key is sent to so many parts of the component, so a large one burdens no task.
PARTS = 64


def fingerprint(text: bytes, words_per_shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: ASCII letters lower-cased, blank-separated words, XXH64 of space-joined shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - words_per_shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return digest(joined, seed)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    begin, end = starts[:n].tolist(), (starts[words_per_shingle:] - 1).tolist()
    h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(begin, end)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words_per_shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, own, fp): fp is the fingerprint as a signed long; ``own`` holds the kept columns as keep0, keep1 and so on."""
    own = F.struct(F.lit(0).alias("none"), *[F.col(f"`{n}`").alias(f"keep{i}") for i, n in enumerate(keep)])
    rows = docs.select(F.col(key).alias("key"), own.alias("own"), shared.clean_text(text).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.claim("simhash")
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words_per_shingle, seed) for t in b.column("t")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("own"), pa.array(fp.view(np.int64))], ["key", "own", "fp"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"key {kinds['key']}, own {kinds['own']}, fp long")


@functools.cache
def _ball(bits: int, within: int) -> np.ndarray:
    """All masks over the lowest ``bits`` bits with at most ``within`` bits set."""
    return np.array([sum(1 << i for i in c) for k in range(within + 1) for c in itertools.combinations(range(bits), k)], np.uint64)


def _volume(bits: int, within: int) -> int:
    return sum(math.comb(bits, k) for k in range(within + 1))


def head_bits(n: int, half: int = 2) -> int:
    """Bits of a variant that the shuffle deals by: the fewest that leave about HEAD_ROWS rows to a head."""
    b = 6
    while b < 40 and n * _volume(b, half) > HEAD_ROWS << b:
        b += 1
    return b


def _joined(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``up``, each row's smallest known companion, after rows a and b have been linked pair by pair."""
    a, b = up[a], up[b]
    while (apart := a != b).any():
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(up, high, low)
        while (higher := up[up]).tobytes() != up.tobytes():
            up = higher
        a, b = up[low], up[high]
    return up


def _meetings(head: np.ndarray, row: np.ndarray, fp: np.ndarray, bits: int, half: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) that share a variant, each variant's rows as one star. At most some ``most`` variants are made at once: more
    are split by the next four bits, so that rows of one variant stay together."""
    low = 64 - bits
    flips = np.bitwise_count((fp >> np.uint64(low)) ^ head)
    sizes = np.bincount(flips, minlength=half + 1)
    if low > 4 and sum(int(sizes[f]) * _volume(low, half - f) for f in range(half + 1)) > most:
        four = (fp >> np.uint64(low - 4)) & np.uint64(15)
        for v in range(16):
            near = flips + np.bitwise_count(four ^ np.uint64(v)) <= half
            if np.count_nonzero(near) > 1:
                yield from _meetings((head[near] << np.uint64(4)) | np.uint64(v), row[near], fp[near], bits + 4, half, most)
        return
    base = fp ^ (((fp >> np.uint64(low)) ^ head) << np.uint64(low))  # the variant's head in place
    made, owners = [], []
    for f in range(half + 1):
        at = np.flatnonzero(flips == f)
        masks = _ball(low, half - f)
        made.append((base[at, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(row[at], len(masks)))
    v = np.concatenate(made)
    s = np.sort(v)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return
    slot = np.searchsorted(twice, v)
    slot[slot == len(twice)] = 0
    hit = np.flatnonzero(twice[slot] == v)
    slot, owner = slot[hit], np.concatenate(owners)[hit]
    lead = np.full(len(twice), -1)
    lead[slot] = owner  # the last one stands
    yield lead[slot], owner


def meet(head: np.ndarray, fp: np.ndarray, bits: int, radius: int = 4, most: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of some heads that share a variant: a star for each of their components.

    Every meeting is verified and merged as it is found, so memory is bounded by ``most`` and the rows, not by the meetings."""
    up = np.arange(len(fp))
    for a, b in _meetings(head, up.copy(), fp, bits, radius // 2, most):
        new = (up[a] != up[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= radius)
        up = _joined(up, a[new], b[new])
    at = np.flatnonzero(up != np.arange(len(fp)))
    return fp[up[at]], fp[at]


def _flips(bits: int) -> Column:
    """In how many bits the beginning of ``fp`` differs from ``head``."""
    return F.bit_count(F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("head")))


def _crowded(rows: DataFrame, bits: int, half: int, full: int) -> DataFrame:
    """(head): those of ``rows`` (head, flips, n) whose rows have more than ``full`` variants."""
    volume = F.element_at(F.array(*[F.lit(_volume(64 - bits, half - f)) for f in range(half + 1)]), F.col("flips") + 1)
    return shared.staged(rows.groupBy("head").agg(F.sum(volume * F.col("n")).alias("variants")).where(F.col("variants") > full).select("head"), "crowded")


def near_links(prints: DataFrame, *, n: int, bits: int | None = None, radius: int = 4, full: int = FULL_HEAD, most: int = AT_ONCE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints at ``radius`` (even) or fewer differing bits.

    Heads with more than ``full`` variants are counted before anything is shuffled by head, and dealt by four more bits, as often
    as it takes."""
    half, odd = divmod(radius, 2)
    if odd or not 0 <= half <= 4:
        raise ValueError("the radius is an even number up to 8")
    bits = bits or head_bits(n, half)
    masks = F.explode(F.array(*[F.lit(int(m)) for m in _ball(bits, half)])).alias("mask")
    beginning = F.shiftrightunsigned("fp", 64 - bits)
    rows = prints.select("fp", masks).select(beginning.bitwiseXOR(F.col("mask")).alias("head"), "fp")
    own = prints.groupBy(beginning.alias("own")).agg(F.count("*").alias("n")).select("own", "n", masks)
    crowded = _crowded(own.select(F.col("own").bitwiseXOR(F.col("mask")).alias("head"), F.bit_count("mask").alias("flips"), "n"), bits, half, full)
    found = []
    while bits <= 56 and not crowded.isEmpty():
        found.append(_met(rows.join(crowded, "head", "left_anti"), bits, radius, most))
        deeper = rows.join(crowded, "head", "left_semi").select("fp", F.col("head").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("v"))
        bits += 4
        deeper = deeper.select(F.shiftleft("h", 4).bitwiseOR(F.col("v").cast("long")).alias("head"), "fp")
        rows = shared.staged(deeper.where(_flips(bits) <= half), "dealt")
        crowded = _crowded(rows.select("head", _flips(bits).alias("flips"), F.lit(1).alias("n")), bits, half, full)
    links = _met(rows, bits, radius, most)
    for more in found:
        links = links.unionByName(more)
    return links


def _met(rows: DataFrame, bits: int, radius: int, most: int) -> DataFrame:
    """Links (a, b) of ``rows`` (head, fp), each head's rows in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        rows = 0

        def links(some: pd.DataFrame) -> pd.DataFrame:
            a, b = meet(some["head"].to_numpy().view(np.uint64), some["fp"].to_numpy().view(np.uint64), bits, radius, most)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for b in batches:
            kept.append(b)
            rows += len(b)
            if rows >= 4 * HEAD_ROWS and b["head"].iloc[0] != b["head"].iloc[-1]:
                some = pd.concat(kept)
                last = (some["head"] == some["head"].iloc[-1]).to_numpy()
                yield links(some[~last])
                kept, rows = [some[last]], int(last.sum())
        if rows:
            yield links(pd.concat(kept))

    return rows.repartition("head").sortWithinPartitions("head", "fp").mapInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words_per_shingle: int = 4, seed: int = 42, radius: int = 4, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, fingerprint, component_id, group, keep...) for every row of ``docs``; ``group`` names the component whatever its
    keys are, also where they are null or repeat. ``keep`` must not name one of the first four."""
    if len({n.lower() for n in (key, "fingerprint", "component_id", "group", *keep)}) < 4 + len(keep):
        raise ValueError("keep repeats the name of a column of the result")
    prints = shared.staged(fingerprints(docs, key=key, text=text, words_per_shingle=words_per_shingle, seed=seed, keep=keep), "prints")
    nodes = shared.staged(prints.groupBy("fp").agg(F.min("key").alias("lead")), "nodes")
    links = shared.staged(near_links(nodes.select("fp"), n=nodes.count(), radius=radius), "links")
    roots = component_labels(links, "a", "b")
    shared.drop_staged(links)
    # Only fingerprints with links need their component's smallest key. It goes to PARTS parts of each component.
    part = F.pmod(F.xxhash64("fp"), F.lit(PARTS))
    linked = shared.staged(nodes.join(roots, nodes.fp == roots.node).select("fp", "lead", F.col("label").alias("root"), part.alias("part")), "linked")
    low = linked.groupBy("root", "part").agg(F.min("lead").alias("low")).groupBy("root").agg(F.min("low").alias("component_id"))
    low = low.select(F.col("root").alias("r"), "component_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("p"))
    named = linked.join(low, (F.col("root") == F.col("r")) & (F.col("part") == F.col("p"))).select("fp", "component_id", "root")
    alone = nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("lead").alias("component_id"), F.col("fp").alias("root"))
    labels = shared.staged(named.unionByName(alone), "labels")
    shared.drop_staged(linked)
    shared.drop_staged(nodes)
    kept = [F.col(f"own.keep{i}").alias(n) for i, n in enumerate(keep)]
    return prints.join(labels, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("root").alias("group"), *kept)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
SQL: dict[str, str] = {}
