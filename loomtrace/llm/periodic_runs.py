"""Periodic runs of words by Kolpakov and Kucherov's method, and texts with each run collapsed to its first period.

A run is a stretch of words with smallest period q and at least ``max(least, times * q)`` words that no neighbour extends. A text is
factorised by a suffix automaton (each factor is the longest that begins earlier as well). A run that touches the border of two
factors is found there by Main's algorithm: two extension tables give, for every period, how far it reaches to both sides. The
border's window is as long as such runs can be. All other runs lie strictly inside a factor, and are copied from the
factor's earlier occurrence, whose runs are known by then. Time and memory are linear in the words.

Only stretches that can hold a run are factorised: a run's words begin grams of ``gram_size`` words that
occur again in the text, so a run lies within one stretch of such grams. The test has no false negatives, as equal grams have equal hashes.

Defined cases: null text has no words; words are ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, whole texts are read, however long, each
within one task; repeated rows are treated alike, each on its own; keys of any type, null or not, are passed through untouched; an empty table gives an
empty result; other columns are not read, unless ``keep`` asks for them; a kept one named like a column of the result raises.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .suffix_automaton import factors

LEAST, TIMES = 24, 3
#: Rows of one result batch.
SLICE = 256
#: Words: what lies between these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def _extensions(a: list[int]) -> list[int]:
    """For every place, how many words from there on equal the list's first ones (the list's length for the first)."""
    n = len(a)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_border(words: Sequence[int], border: int, left: int, size: int, least: int, times: int, found: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Add the runs that touch ``border`` and lie in the ``left`` words before it and the ``size`` words after it; returns new ones."""
    t, u = list(words[border - left : border]), list(words[border : border + size])
    ahead = _extensions([*u, -1, *t, *u])  # common prefixes with what follows the border
    t.reverse()
    u.reverse()
    back = _extensions([*t, -1, *u, *t])  # common suffixes with what precedes it
    n, fresh = len(words), []
    most = (left + size) // times

    def keep(s: int, e: int, q: int) -> None:
        if e - s >= least and (s == 0 or words[s - 1] != words[s - 1 + q]) and (e == n or words[e] != words[e - q]):
            if (s, e) not in found:
                fresh.append((s, e))
                found[s, e] = q
            elif q < found[s, e]:
                found[s, e] = q

    for q in range(1, min(size, most) + 1):
        before, after = back[left + 1 + size - q] if left else 0, ahead[q] if q < size else 0
        if before + after >= q * (times - 1):
            keep(border - before, border + q + after, q)
    for q in range(1, min(left, most) + 1):
        before, after = back[q] if q < left else 0, ahead[size + 1 + left - q] if size else 0
        if before + after >= q * (times - 1):
            keep(border - q - before, border + after, q)
    return fresh


def runs_of(words: Sequence[int], *, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of words given as numbers from 0, by start, then period."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}  # (start, end): smallest period
    at: dict[int, list[int]] = {}  # start: ends
    before = 0
    for begin, size, source in [*factors(words), (n, 0, -1)]:
        if begin:
            # A run that ends beyond the border begins less than one period before the factor that ends there: that factor
            # would reach further otherwise. So times * period < before + size + period.
            left = min(begin, before + (before + size) // (times - 1) + 1)
            if left + size >= least:
                for s, e in _at_border(words, begin, left, size, least, times, found):
                    at.setdefault(s, []).append(e)
        if size > least and source >= 0 and at:
            by, stop = begin - source, source + size
            for s in range(source + 1, stop - least):
                for e in at.get(s, ()):
                    if e < stop and (s + by, e + by) not in found:
                        found[s + by, e + by] = found[s, e]
                        at.setdefault(s + by, []).append(e + by)
        before = size
    return sorted((s, e - s, q) for (s, e), q in found.items())


def gram_size(least: int, times: int) -> int:
    """Words that recur one period on, from each of a run's places to at most its end, in every run there may be."""
    return 1 + min(max(least, times * q) - 2 * q for q in range(1, least + 1))


def stretches(words: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """[begin, end) of maximal stretches all of whose grams occur again in the text."""
    n = len(words) - gram + 1
    if n < 2:
        return []
    h = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    g = np.zeros(n, np.uint64)
    for k in range(gram):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    again = np.zeros(n + 2, bool)
    again[1 + order[1:]] |= same
    again[1 + order[:-1]] |= same
    begins, ends = np.flatnonzero(again[1:] & ~again[:-1]), np.flatnonzero(again[:-1] & ~again[1:])
    return [(b, e + gram - 1) for b, e in zip(begins.tolist(), ends.tolist())]


def runs_of_text(words: list[bytes], *, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(words):
        return []
    out = []
    for b, e in stretches(np.array(ids), gram_size(least, times)):
        if e - b >= least:
            out += [(b + s, length, q) for s, length, q in runs_of(ids[b:e], least=least, times=times)]
    return sorted(set(out))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        gone[s + q] += 1
        gone[s + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def find_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(key, runs, n_words, collapsed, keep...): every row's runs as (start, length, period) by start, then period, and its kept words joined by
    blanks."""
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    out_names = (key, "runs", "n_words", "collapsed")
    if len({n.lower() for n in (*out_names, *keep)}) < 4 + len(keep):
        raise ValueError("keep repeats the name of a column of the result")
    own = F.struct(F.col(f"`{key}`").alias("key"), *[F.col(f"`{n}`").alias(f"keep{i}") for i, n in enumerate(keep)])
    rows = docs.select(own.alias("own"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("body"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.claim("periodic_runs")
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                runs, sizes, kept = [], [], []
                for body in b.column("body"):
                    words = body.as_py().split()
                    found = runs_of_text(words, least=least, times=times)
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    sizes.append(len(words))
                    kept.append(b" ".join(collapsed(words, found)))
                columns = [b.column("own"), pa.array(runs, run_type), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["own", "runs", "n_words", "collapsed"])

    kind = rows.schema["own"].dataType.simpleString()
    found = rows.mapInArrow(find, f"own {kind}, runs array<struct<start: long, length: long, period: long>>, n_words long, collapsed binary")
    return found.select(F.col("own.key").alias(key), "runs", "n_words", F.col("collapsed").cast("string").alias("collapsed"), *[F.col(f"own.keep{i}").alias(n) for i, n in enumerate(keep)])


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, compared exactly; of equal ones the first. Null if there is none."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the query's contract: where the checksum h of the id is a multiple of 10, the words from place a on repeat the p
    words there; a and p follow from h. Only such texts change; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = docs.where(h % 10 == 0).select("doc_id", g.alias("g"), words.alias("w")).withColumn("n", F.size("w")).where("n > 0")
    a = F.expr("cast(g % n as int)")
    p = F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)")
    unit = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), 1, F.col("n") - F.col("a"))
    planted = chosen.withColumn("a", a).withColumn("p", p).select("doc_id", F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ").alias("text"))
    # No words: the text has nothing to repeat and stays.
    same = ~F.coalesce((h % 10 == 0) & F.col("text").rlike(WORD), F.lit(False))
    return docs.where(same).select("doc_id", "text").unionByName(planted)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(shared.table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
SQL: dict[str, str] = {}
