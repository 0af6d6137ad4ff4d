"""Repeated passages of words over a whole corpus, by suffix automata of reference shards and matching statistics.

The reference is the corpus itself, so it grows with it, and so would automata that every document streams through. Therefore
documents and reference are dealt alike: every ``window`` words of a text contain an anchor, the gram of ``GRAM`` words with the
smallest hash, so equal windows have equal anchors at equal places. A text is cut into pieces, the words of all windows that one
anchor stands for. Anchors that occur once cannot be part of a repeat. Pieces that recur whole are repeated, and one
of them stands for all. Of an anchor with differing pieces each distinct one goes to the shard that the anchor's hash names. A
shard builds one automaton of its pieces and streams them through it: the matching statistic at a word is the longest match that
ends there and occurs twice; where it reaches the window, that many words are covered.

A hot anchor, with more than ``SHARD_KINDS`` distinct pieces, is dealt by whole windows instead: those that recur are covered. Nothing is
dropped, and no key gathers an unbounded group.

:func:`remove_known` removes what a given reference holds. Its automata are broadcast, at most ``PASS_WORDS`` words at a time,
and every document is streamed through them.

Words are told by 64-bit hashes, pieces by two of them, texts by SHA-256. Rows of one text go through all this once: from the
window's length on they repeat each other whole.

Defined cases: null text has no words; words are ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; texts with fewer words than the window keep all;
repeated rows repeat each other, so they lose everything from the window's length on; ids play no part, so null and
repeated ones do no harm; whole texts are read, however long; matches never cross texts; an empty table gives an empty
result. Columns other than key and text are not read, unless ``keep`` asks for them; a kept one named like a column of
the result raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import numbered
from . import shared
from .suffix_automaton import SuffixAutomaton
from .suffix_dedup import _distinct, _joined, _settle

WINDOW, GRAM = 35, 8
#: Distinct pieces of one anchor that a shard takes at most, and words of one automaton (a shard's last anchor may exceed them).
SHARD_KINDS, SHARD_WORDS = 512, 1 << 15
#: Window starts that are looked at together.
STRETCH = 1 << 18
#: A given reference: words of a piece, and of all pieces that are broadcast at a time (8 bytes a word there, some 400 in a worker).
PIECE_WORDS, PASS_WORDS = 1 << 13, 1 << 18
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 18
_P, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(body: bytes) -> np.ndarray:
    """The hash of every word of a text."""
    words = body.split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def anchored(h: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, first window, last window) of a text's anchors, a stretch of windows at a time; the key is the gram's hash."""
    w = window - GRAM + 1
    for at in range(0, len(h) - window + 1, STRETCH):
        b = h[at : at + STRETCH + window - 1]
        g = b[: len(b) - GRAM + 1].copy()
        for k in range(1, GRAM):
            g = g * _P + b[k : k + len(g)]
        g ^= g >> np.uint64(29)
        g *= _MIX
        g ^= g >> np.uint64(32)
        low = np.uint64((1 << 20) - 1)
        order = (g & ~low) | np.arange(len(g), dtype=np.uint64)  # the leftmost of equal grams
        m, s = order, 1
        while 2 * s <= w:
            m, s = np.minimum(m[:-s], m[s:]), 2 * s
        starts = len(g) - w + 1
        pos = (np.minimum(m[:starts], m[w - s : w - s + starts]) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
        last = np.r_[first[1:] - 1, starts - 1]
        yield g[pos[first]].view(np.int64), first + at, last + at


def covered_words(pieces: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int]]:
    """(piece, begin, end) of the words that lie in a repeat of ``window`` words or more within these pieces; spans of a piece in order, disjoint."""
    texts = [p.tolist() for p in pieces]
    automaton = SuffixAutomaton(texts)
    twice, length, link = automaton.repeated_lengths(), automaton.length, automaton.link
    for i, text in enumerate(texts):
        begin = end = -1
        for at, (matched, state) in enumerate(automaton.matching_statistics(text), 1):
            # A match shorter than its state's longest substring occurs as often as that.
            again = matched if twice[state] == length[state] else min(matched, twice[link[state]] if link[state] > 0 else 0)
            if again >= window:
                if at - again > end:
                    if end > 0:
                        yield i, begin, end
                    begin = at - again
                begin, end = min(begin, at - again), at
        if end > 0:
            yield i, begin, end


def repeated_spans(texts: DataFrame, *, window: int = WINDOW, shard_kinds: int = SHARD_KINDS) -> DataFrame:
    """(id, spans): the repeated words of each of the distinct texts (id, z, size) that has any, as [start, end) word numbers
    in no order, possibly overlapping."""
    import xxhash

    if window <= GRAM:
        raise ValueError(f"the window must exceed {GRAM} words")
    # A window takes at least one byte and one blank a word.
    long_enough = texts.where(F.col("size") >= 2 * window - 1).select("id", "z")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        digest, spread = xxhash.xxh64_intdigest, zstandard.ZstdDecompressor().decompress
        shared.claim("substring_dedup", _hashes.clear)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                keys, prints, own, firsts, counts = [], [], [], [], []
                for i, z in zip(b.column("id").to_pylist(), b.column("z")):
                    h = word_hashes(spread(z.as_buffer()))
                    for key, first, last in anchored(h, window):
                        raw, ends = memoryview(h).cast("B"), last + window
                        prints += [digest(raw[8 * x : 8 * y]) for x, y in zip(first.tolist(), ends.tolist())]
                        keys.append(key)
                        firsts.append(first)
                        counts.append(last - first + 1)
                        own.append(np.full(len(key), i))
                if keys:
                    columns = [np.concatenate(keys), np.array(prints, np.uint64).view(np.int64), np.concatenate(own), np.concatenate(firsts).astype(np.int32), np.concatenate(counts).astype(np.int16)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "ch", "id", "first", "n"])

    found = shared.staged(long_enough.mapInArrow(find, "key long, ch long, id long, first int, n short"), "anchors")
    # Written first: as a table of its own it is dealt anew for the join, so the join can split a frequent key.
    twice = shared.staged(found.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select(F.col("key").alias("k_key")), "twice")
    candidates = shared.staged(found.join(twice, F.col("key") == F.col("k_key")).drop("k_key"), "candidates")
    shared.drop_staged(found)
    _settle(texts.sparkSession)

    # Pieces are still told by their hashes here; no text has moved.
    kinds = shared.staged(candidates.groupBy("key", "ch").agg(F.count("*").alias("times"), F.min(F.struct("id", "first", "n")).alias("rep")), "kinds")
    again = kinds.where("times > 1").select(F.col("key").alias("k_key"), F.col("ch").alias("k_ch"))
    span = [F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + window).alias("end")]
    covered = [shared.staged(candidates.join(again, (F.col("key") == F.col("k_key")) & (F.col("ch") == F.col("k_ch"))).select("id", *span), "covered")]
    many = shared.staged(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumnRenamed("key", "k_key"), "many")
    wanted = kinds.join(many, F.col("key") == F.col("k_key")).select("key", "kinds", "rep.id", "rep.first", "rep.n")
    wanted = shared.staged(wanted, "wanted")
    shared.drop_staged(candidates)
    shared.drop_staged(kinds)
    _settle(texts.sparkSession)

    # Fetch the pieces' words from the texts; a text is there once, so a piece is, too.
    asked = wanted.groupBy("id").agg(F.collect_list(F.struct("key", "kinds", "first", "n")).alias("asked")).withColumnRenamed("id", "w_id")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        spread = zstandard.ZstdDecompressor().decompress
        shared.claim("substring_dedup", _hashes.clear)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = []
                for i, z, wants in zip(b.column("id").to_pylist(), b.column("z"), b.column("asked").to_pylist()):
                    h = word_hashes(spread(z.as_buffer()))
                    out += [(a["key"], a["kinds"], i, a["first"], h[a["first"] : a["first"] + a["n"] - 1 + window].tobytes()) for a in wants]
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "kinds", "id", "first", "piece"])

    fetched = long_enough.join(asked, F.col("id") == F.col("w_id")).drop("w_id").mapInArrow(fetch, "key long, kinds long, id long, first int, piece binary")
    pieces = shared.staged(fetched, "pieces")
    shared.drop_staged(wanted)
    _settle(texts.sparkSession)
    covered.append(_covered_by_windows(pieces.where(F.col("kinds") > shard_kinds), window))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def spans(some: pd.DataFrame) -> pd.DataFrame:
            found = list(covered_words([np.frombuffer(p, np.uint64) for p in some["piece"]], window))
            who, begin, end = np.array(found, np.int64).reshape(-1, 3).T
            first = some["first"].to_numpy(np.int64)[who]
            return pd.DataFrame({"id": some["id"].to_numpy()[who], "start": first + begin, "end": first + end})

        kept: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            edge = np.flatnonzero(np.diff(b["key"].to_numpy())) + 1
            for part in np.split(np.arange(len(b)), edge):
                part = b.iloc[part]
                if kept and len(part) and size >= SHARD_WORDS and kept[-1]["key"].iloc[-1] != part["key"].iloc[0]:
                    yield spans(pd.concat(kept))
                    kept, size = [], 0
                kept.append(part)
                size += sum(map(len, part["piece"])) // 8
        if size:
            yield spans(pd.concat(kept))

    dealt = pieces.where(F.col("kinds") <= shard_kinds).drop("kinds").repartition("key").sortWithinPartitions("key", "id", "first")
    covered.append(shared.staged(dealt.mapInPandas(stream, "id long, start int, end int"), "covered"))
    shared.drop_staged(pieces)
    _settle(texts.sparkSession)
    out = covered[0]
    for c in covered[1:]:
        out = out.unionByName(c)
    return out.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _covered_by_windows(hot: DataFrame, window: int) -> DataFrame:
    """(id, start, end): windows of these pieces that occur more than once, each on its own. Equal windows meet by two hashes, and are
    counted before they are dealt."""
    import xxhash

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (lambda x: xxhash.xxh64_intdigest(x, 1)), (lambda x: xxhash.xxh64_intdigest(x, 2))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids, starts, pair = [], [], []
                for i, first, piece in zip(b.column("id").to_pylist(), b.column("first").to_pylist(), b.column("piece").to_pylist()):
                    for k in range(len(piece) // 8 - window + 1):
                        w = piece[8 * k : 8 * (k + window)]
                        ids.append(i)
                        starts.append(first + k)
                        pair.append((one(w), two(w)))
                x, y = np.array(pair, np.uint64).reshape(-1, 2).T.copy().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(x), pa.array(y)], ["id", "start", "x", "y"])

    windows = shared.staged(hot.select("id", "first", "piece").mapInArrow(split, "id long, start int, x long, y long"), "windows")
    again = windows.groupBy("x", "y").agg(F.count("*").alias("times")).where("times > 1").select(F.col("x").alias("k_x"), F.col("y").alias("k_y"))
    again = shared.staged(again, "again")
    found = windows.join(again, (F.col("x") == F.col("k_x")) & (F.col("y") == F.col("k_y"))).select("id", "start", (F.col("start") + window).alias("end"))
    found = shared.staged(found, "covered")
    shared.drop_staged(windows)
    return found


def _names(key: str, keep: tuple[str, ...]) -> tuple[str, ...]:
    names = (key, "kept", "n_words", "n_removed", "n_spans")
    if len({n.lower() for n in (*names, *keep)}) < 5 + len(keep):
        raise ValueError("keep repeats the name of a column of the result")
    return names


def _without_spans(body: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int, int]:
    """(kept words joined by blanks, words, removed words, maximal removed spans)."""
    words = body.split()
    x, y = _joined(starts.astype(np.int64), ends.astype(np.int64)) if len(starts) else (starts, ends)
    edges = [0, *np.column_stack([x, y]).ravel().tolist(), len(words)]
    left = [w for i, j in zip(edges[::2], edges[1::2]) for w in words[i:j]]
    return b" ".join(left), len(words), len(words) - len(left), len(x)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), shard_kinds: int = SHARD_KINDS) -> DataFrame:
    """(key, kept, n_words, n_removed, n_spans, keep...): the words of every row that no repeat covers, joined by blanks. ``keep``
    must not name one of the first five."""
    names = _names(key, keep)
    texts = _distinct(docs, key, text, keep)
    spans = repeated_spans(texts, window=window, shard_kinds=shard_kinds).withColumnRenamed("id", "s_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        spread = zstandard.ZstdDecompressor().decompress
        none = np.zeros(0, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                out = []
                for z, times, s in zip(b.column("z"), b.column("times").to_pylist(), b.column("spans")):
                    body = spread(z.as_buffer())
                    if times > 1:  # rows of one text repeat each other
                        n = len(body.split())
                        x, y = (np.array([0]), np.array([n])) if n >= window else (none, none)
                    elif s.is_valid:
                        x, y = (s.values.field(k).to_numpy() for k in (0, 1))
                    else:
                        x = y = none
                    out.append(_without_spans(body, x, y))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("own"), *columns], ["digest", "own", *names[1:]])

    kind = texts.schema["own"].dataType.simpleString()
    result = f"digest string, own {kind}, kept binary, n_words long, n_removed long, n_spans long"
    read = ["digest", "own", "times", "z"]
    alone = texts.where("times = 1").select("id", *read).join(spans, F.col("id") == F.col("s_id"), "left").select(*read, "spans").mapInArrow(run, result)
    own = lambda row: [row("key").alias(key), F.col("kept").cast("string").alias("kept"), *names[2:], *[row(f"keep{i}").alias(n) for i, n in enumerate(keep)]]
    single = alone.select(*own(lambda c: F.col(f"own.{c}")))
    # Copies: the text is worked out once and joined to its rows by digest, without moving texts.
    no_spans = F.lit(None).cast("array<struct<start: int, end: int>>").alias("spans")
    several = shared.staged(texts.where("times > 1").select(*read, no_spans).mapInArrow(run, result).drop("own"), "copies")
    rows = docs.select(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("r_digest"), F.struct(F.col(f"`{key}`").alias("key"), *[F.col(f"`{n}`").alias(f"keep{i}") for i, n in enumerate(keep)]).alias("own"))
    return single.unionByName(rows.join(several, F.col("r_digest") == F.col("digest")).select(*own(lambda c: F.col(f"own.{c}"))))


def remove_known(docs: DataFrame, reference: DataFrame, *, window: int = WINDOW, key: str = "doc_id", text: str = "text", known: str = "text", pass_words: int = PASS_WORDS) -> DataFrame:
    """(key, kept, n_words, n_removed, n_spans): the words of every row that no passage of ``window`` words or more of the reference's texts
    covers. The reference is cut into overlapping pieces; automata of ``pass_words`` words are broadcast at a time, and each pass
    streams all documents through them, so memory is bounded for any reference and time grows with documents times passes."""
    names = _names(key, ())
    step = PIECE_WORDS - window + 1
    if step < 1:
        raise ValueError(f"the window must not exceed {PIECE_WORDS} words")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body in b.column("body").to_pylist():
                h = word_hashes(body)
                out += [h[at : at + PIECE_WORDS].tobytes() for at in range(0, max(len(h) - window + 1, 0), step)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["piece"])

    body = F.coalesce(F.col(f"`{known}`").cast("string"), F.lit("")).cast("binary").alias("body")
    pieces = reference.select(body).mapInArrow(cut, "piece binary").distinct()
    placed = numbered(pieces, F.xxhash64("piece"), "piece")
    each = max(1, pass_words // PIECE_WORDS)
    total = placed.count()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = shared.staged(rows.withColumn("at", F.monotonically_increasing_id()), "documents")
    found = None
    for low in range(0, total, each):
        few = [r["piece"] for r in placed.where(F.col("place").between(low, low + each - 1)).select("piece").collect()]
        held = docs.sparkSession.sparkContext.broadcast(few)  # at most pass_words words
        part = shared.staged(rows.mapInArrow(_streamed(held, window), "at long, spans array<struct<start: int, end: int>>"), "known")
        held.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "at long, spans array<struct<start: int, end: int>>")
    spans = found.groupBy("at").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumnRenamed("at", "s_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in batches:
            out = [_without_spans(t, *((s.values.field(k).to_numpy() for k in (0, 1)) if s.is_valid else (none, none))) for t, s in zip(b.column("body").to_pylist(), b.column("spans"))]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("key"), *columns], ["key", *names[1:]])

    kind = rows.schema["key"].dataType.simpleString()
    joined = rows.join(spans, F.col("at") == F.col("s_at"), "left").select("key", "body", "spans")
    out = joined.mapInArrow(run, f"key {kind}, kept binary, n_words long, n_removed long, n_spans long")
    return out.select(F.col("key").alias(key), F.col("kept").cast("string").alias("kept"), *names[2:])


def _streamed(held, window: int):
    """The function that streams documents through the automaton of broadcast pieces; a worker builds it once a task."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.claim("substring_dedup", _hashes.clear)
        automaton = SuffixAutomaton(np.frombuffer(p, np.uint64).tolist() for p in held.value)
        for b in batches:
            ats, spans = [], []
            for at, body in zip(b.column("at").to_pylist(), b.column("body").to_pylist()):
                own: list[dict[str, int]] = []
                for end, (matched, _) in enumerate(automaton.matching_statistics(word_hashes(body).tolist()), 1):
                    if matched >= window:
                        if own and end - matched <= own[-1]["end"]:
                            own[-1]["end"] = end
                            own[-1]["start"] = min(own[-1]["start"], end - matched)
                        else:
                            own.append({"start": end - matched, "end": end})
                if own:
                    ats.append(at)
                    spans.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["at", "spans"])

    return stream


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(shared.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op13_substring_dedup": op13_substring_dedup}
SQL: dict[str, str] = {}
