"""Packing documents into token windows by bounded-space online best fit.

Each partition keeps at most ``open_windows`` windows. A document of more than a window is first cut into full
windows and a rest; a piece goes to the open window that it fills best; when none has room the fullest window is
topped up with a part of the piece if its gap is at least ``min_cut`` ids, emitted, and replaced by a new one. What
is open when a partition ends is merged: the pieces of those windows meet, by groups of partitions, in a
second round of the same placement (without cuts, longest piece first), so only a few windows of each merging task
stay part-filled.

Defined cases: null text counts as empty, and every document has at least the closing id, so none is lost; repeated
rows and rows of null or repeated keys are packed as documents of their own, told apart by ``row``; a very long text fills
windows of its own and is never cut off; equal fits go to the window opened first; an empty table gives an empty result; other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Words that a worker remembers at most, and the letters of the longest: beyond it the table starts anew, after a slice of
#: texts long words are forgotten, so what is kept is bounded in bytes, too.
CACHE_ENTRIES, LONGEST_WORD = 200_000, 64
#: Texts that a worker has as objects at once.
SLICE = 256
#: The vocabulary's pattern and word-end mark.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: A byte that UTF-8 never holds.
MARK = b"\xff"
#: Letters below have one lower-case form and no combining marks, but for one.
BEYOND_LATIN, DOTTED_I = "\u0250", "\u0130"
#: Characters that Python's split() takes for white space and the library does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


class WordTokenizer:
    """Ids of whole texts as the library gives them. The vocabulary's pattern never spans white space, so each distinct
    blank-separated word is encoded once and remembered.

    Words of Latin letters go through the merges alone: a byte that no text holds marks the end of a word, so a last
    byte with its mark is one symbol and the marked merges follow by rank. All other words, and texts with special strings, are
    encoded by the library itself."""

    def __init__(self, vocabulary: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        from .token_counts import byte_alphabet

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        self.long = False  # whether words are known that are to be forgotten
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, letter = model["vocab"], byte_alphabet()
        back = {c: b for b, c in letter.items()}

        def raw(symbol: str) -> bytes:
            whole = symbol.endswith(WORD_END)
            return bytes(back[c] for c in (symbol[: -len(WORD_END)] if whole else symbol)) + MARK * whole

        # Ranks: a byte with the mark comes first, single bytes are never made, then the merges in their order.
        ranks = {bytes([b]) + MARK: b for b in range(255)} | {bytes([b]): 256 + b for b in range(256)}
        found = [ids[letter[b] + WORD_END] for b in range(255)] + [0] + [ids[letter[b]] for b in range(256)]
        for i, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            ranks[raw(x) + raw(y)] = 512 + i
            found.append(ids[x + y])
        #: Little-endian bytes of the id of each rank.
        self.ids = [i.to_bytes(4, "little") for i in found]
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(SPLIT)

    def _whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        found = self.library.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _piece(self, low: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.merge(low.encode() + MARK)))

    def _learn(self, words: list[str]) -> None:
        known, piece, odd = self.known, self._piece, []
        self.long = any(len(w) > LONGEST_WORD for w in words)
        for w in words:
            if w.isascii() or max(w) < BEYOND_LATIN and DOTTED_I not in w:
                low = w.lower()
                if low.isalpha():
                    known[w] = piece(low)
                elif low[-1] in ",." and low[:-1].isalpha():
                    known[w] = piece(low[:-1]) + piece(low[-1])
                else:
                    known[w] = b"".join(map(piece, self.split.findall(low)))
            else:
                odd.append(w)
        for at in range(0, len(odd), 20_000):
            known.update(zip(odd[at : at + 20_000], self._whole(odd[at : at + 20_000])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [not (SEPARATORS.search(t) or any(s in t for s in self.special)) for t in texts]
        words = [t.split() if ok else [] for t, ok in zip(texts, plain)]
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        self._learn([w for w in set(chain.from_iterable(words)) if w not in known])
        get = known.__getitem__
        out = [b"".join(map(get, ws)) if ok else self._whole([t])[0] for t, ok, ws in zip(texts, plain, words)]
        for w in [w for w in known if len(w) > LONGEST_WORD] if self.long else ():
            del known[w]
        self.long = False
        return out


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str) -> WordTokenizer:
    return WordTokenizer(vocabulary)


class OpenWindows:
    """At most ``space`` part-filled windows, found by their gap."""

    def __init__(self, size: int, space: int):
        self.size, self.space = size, space
        self.gaps: list[tuple[int, int]] = []  # (gap, window), ascending
        self.windows: dict[int, list] = {}
        self.next = 0

    def place(self, length: int, item: object) -> bool:
        at = bisect.bisect_left(self.gaps, (length, -1))
        if at < len(self.gaps):
            gap, w = self.gaps.pop(at)
        elif len(self.gaps) < self.space:
            gap, w = self.size, self.next
            self.windows[w], self.next = [], self.next + 1
        else:
            return False
        self.windows[w].append(item)
        bisect.insort(self.gaps, (gap - length, w))
        return True

    def fullest(self) -> int:
        """The smallest gap, 0 if no window is open."""
        return self.gaps[0][0] if self.gaps else 0

    def pop_full(self) -> Iterator[list]:
        while self.gaps and self.gaps[0][0] == 0:
            yield self.emit()

    def emit(self) -> list:
        return self.windows.pop(self.gaps.pop(0)[1])


PIECE = "doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, row long"


def pack(
    docs: DataFrame, vocabulary: str, *, window: int = 2048, end_id: int = 1, open_windows: int = 24, min_cut: int = 64, merge_partitions: int = 32, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``row``, which tells the pieces of
    repeated rows of one document apart.

    Whole texts are tokenized once, in the scan's partitions; only rows of placed pieces leave the workers, and only
    those of windows left open are shuffled (``open_windows`` a partition at most)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def table(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        """Rows of pieces; keys are never numbers of another kind, so null ones beside large ones stay what they are."""
        columns = zip(*rows) if rows else [()] * len(OUT)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (key_type, *KINDS))], OUT)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.claim("packing", tokenizer.cache_clear)
        tok, task = tokenizer(vocabulary), TaskContext.get().partitionId()
        tail = end_id.to_bytes(4, "little")
        space, serial, row = OpenWindows(window, open_windows), 0, (task << 36) - 1
        for b in batches:
            rows: list[tuple] = []

            def write(pieces: list, closed: bool) -> None:
                nonlocal serial
                offset = 0
                for p in pieces:
                    rows.append((*p, task, serial, offset, closed))
                    offset += p[2]
                serial += 1

            key_type = b.column("k").type
            for at in range(0, b.num_rows, SLICE):
                some = b.slice(at, SLICE)
                for k, ids in zip(some.column("k").to_pylist(), tok.encode(some.column("t").to_pylist())):
                    ids += tail
                    row += 1
                    total = len(ids) // 4
                    piece = lambda s, n: (k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), total, row)  # noqa: B023, E731
                    start = 0
                    while total - start >= window:
                        write([piece(start, window)], True)
                        start += window
                    while (n := total - start) and not space.place(n, piece(start, n)):
                        gap = space.fullest()
                        if min_cut <= gap < n:
                            space.place(gap, piece(start, gap))
                            start += gap
                        write(space.emit(), True)
                    for full in space.pop_full():
                        write(full, True)
            yield table(rows, key_type)
        rows = []
        while space.gaps:
            pieces, offset = space.emit(), 0
            for p in pieces:
                rows.append((*p, task, serial, offset, False))
                offset += p[2]
            serial += 1
        if rows:
            yield table(rows, key_type)

    OUT = ["doc", "start", "length", "ids_crc32", "doc_tokens", "row", "task", "serial", "offset", "closed"]
    KINDS = (pa.int64(),) * 5 + (pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    schema = PIECE.format(kind=kind) + ", task int, serial long, offset long, closed boolean"
    t = F.coalesce(F.col(text), F.lit(""))
    first = shared.staged(docs.select(F.col(key).alias("k"), t.alias("t")).mapInArrow(place, schema), "placed")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        space, serial = OpenWindows(window, 4 * open_windows), 0

        def rows(pieces: list) -> list[tuple]:
            nonlocal serial
            offset, out = 0, []
            for p in pieces:
                out.append((*p, task, serial, offset, True))
                offset += p[2]
            serial += 1
            return out

        for b in batches:
            out: list[tuple] = []
            key_type = b.column("doc").type
            for p in zip(*(b.column(c).to_pylist() for c in OUT[:6])):
                while not space.place(p[2], p):
                    out += rows(space.emit())
                for full in space.pop_full():
                    out += rows(full)
            yield table(out, key_type)
        out = []
        while space.gaps:
            out += rows(space.emit())
        if out:
            yield table(out, key_type)

    group = F.floor(F.col("task") / merge_partitions)
    left = first.where("not closed")
    merged = left.repartition(group, F.pmod(F.xxhash64("row", "start"), F.lit(2)))
    merged = merged.sortWithinPartitions(F.desc("length"), "row", "start").mapInArrow(merge, schema)
    # A window is named by its stage (0 placed, 1 merged), task and number in the task.
    name = lambda stage: (F.lit(stage).cast("long") * F.lit(1 << 62) + F.col("task").cast("long") * F.lit(1 << 36) + F.col("serial")).alias("sequence_id")
    columns = [F.col("doc").alias(key), "start", "length", "ids_crc32", "doc_tokens"]
    return first.where("closed").select(*columns, name(0), "offset", "row").unionByName(merged.select(*columns, name(1), "offset", "row"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op7_packing": op7_packing}
SQL: dict[str, str] = {}
