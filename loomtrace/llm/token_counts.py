"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

For one pre-token the table ``last[i]`` holds the final token of the encoding of its first ``i`` bytes and
``count[i]`` the number of tokens. A token ``t`` ends the encoding of a prefix exactly if the token before it and
``t`` stand side by side unmerged, so ``count[i] = count[i - len(t)] + 1`` for the one suffix token that is
compatible with ``last[i - len(t)]``; an automaton over the vocabulary gives the suffix tokens of all prefixes in one pass. Texts
are sums over blank-separated chunks, whose totals are remembered. The exact count after every ``STEP`` characters is stored with
each text, so "how many tokens has this prefix", "where does a budget of n tokens end" and "is it over the limit" are answered by
a search in the stored counts and the tables of the characters up to the next of them, without encoding the text again.

Defined cases: null text counts as empty (0 tokens); special strings are one token each, as the library's default; a very long
text or word takes time in proportion to its length, and words beyond ``LONGEST_CHUNK`` letters are not remembered; rows that
repeat, also under one key or none, give rows of their own; an empty table gives an empty result; other columns of the input are
not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The split pattern of the public byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'re", "'ve", "'ll")
#: Chunks, pre-tokens and token pairs that a worker remembers at most, beyond which a table starts anew, and the letters of the
#: longest that it remembers.
CACHE_ENTRIES, LONGEST_CHUNK = 500_000, 48
#: Characters between two stored counts.
STEP = 1024
NEVER = 1 << 60
#: A blank inside a run of white space: such a run is cut elsewhere than at its blanks.
INNER_BLANK = re.compile(r"\s (?:\s|$)")
#: Stands between pre-tokens that are looked at together; no byte does.
APART = "\u0100"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, all others are numbered upwards from U+0100 in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix token counts for a byte-level BPE vocabulary file in the ``tokenizers`` JSON format."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        raw = lambda s: bytes(back[c] for c in s)
        ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.rank: dict[tuple[int, int], int] = {}
        #: How each token is made: the rank of its merge and its two halves; single bytes are not.
        self.made: list[tuple[int, int, int] | None] = [None] * 256
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = map(raw, m if isinstance(m, list) else m.split(" "))
            pair = ids[a], ids[b]
            self.rank[pair] = i
            if a + b not in ids:
                ids[a + b] = len(self.made)
                self.made.append((i, *pair))
        #: Tokens as Latin-1 strings, with length and number.
        self.suffixes = ahocorasick.Automaton()
        for t, i in ids.items():
            self.suffixes.add_word(t.decode("latin-1"), (len(t), i))
        self.suffixes.make_automaton()
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.special_heads = tuple(specials)
        self.split = regex.compile(SPLIT)
        self.blank = regex.compile(r"\s*")
        self._beside: dict[int, bool] = {}
        self._totals: dict[str, int] = {}
        self._chunks: dict[str, int] = {}

    def _stand_beside(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart: going back through the merges that made the tokens at their
        border, no merge across it comes before those that take its two sides away. Equal merges go left to right."""
        x, y, x_gone, y_gone = left, right, NEVER, NEVER
        rank, made = self.rank, self.made
        while True:
            m = rank.get((x, y))
            if m is not None and m < x_gone and m <= y_gone:
                return False
            x_made, y_made = made[x], made[y]
            if x_made is not None and (y_made is None or x_made[0] > y_made[0]):
                x_gone, x = x_made[0], x_made[2]
            elif y_made is not None:
                y_gone, y = y_made[0], y_made[1]
            else:
                return True

    def _tables(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Token counts of every byte prefix of each pre-token, index 0 to its length."""
        beside, stand = self._beside, self._stand_beside
        pieces_left = iter(pieces)
        base = size = 0
        count: list[int] = []
        last: list[int] = []
        # One pass of the automaton over all of them; at each end it names the longest token first.
        for end, (n, t) in self.suffixes.iter(APART.join(p.decode("latin-1") for p in pieces)):
            at = end - base + 1
            if at > size:  # the next pre-token
                if size:
                    yield count
                    base += size + 1
                while not (size := len(next(pieces_left))):
                    yield [0]
                    base += 1
                count, last, at = [0], [0], end - base + 1
            if at == len(count):
                start = at - n
                if start:
                    pair = last[start] << 20 | t
                    fits = beside.get(pair)
                    if fits is None:
                        fits = beside[pair] = stand(last[start], t)
                    if not fits:
                        continue
                count.append(count[start] + 1)
                last.append(t)
        if size:
            yield count
        for _ in pieces_left:
            yield [0]

    def piece_counts(self, piece: bytes) -> list[int]:
        return next(self._tables([piece]))

    def learn(self, pieces: list[str]) -> None:
        """Totals of new pre-tokens."""
        for piece, counts in zip(pieces, self._tables([p.encode() for p in pieces])):
            self._totals[piece] = counts[-1]

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        if self.special is None or not any(s in text for s in self.special_heads):
            yield text, False
            return
        for k, part in enumerate(self.special.split(text)):
            if part:
                yield part, bool(k % 2)

    def _learn_chunks(self, chunks: list[str]) -> None:
        """Totals of chunks, each behind the blank that comes before it."""
        split, totals = self.split.findall, self._totals
        parts = [split(" " + c) for c in chunks]
        self.learn([p for p in set(chain.from_iterable(parts)) if p not in totals])
        known = totals.__getitem__
        self._chunks.update((c, sum(map(known, ps))) for c, ps in zip(chunks, parts))

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        parts = self.split.findall(text)
        self.learn([p for p in set(parts) if p not in self._totals])
        return sum(map(self._totals.__getitem__, parts))

    def _forget(self) -> None:
        for table in (self._totals, self._beside, self._chunks):
            if len(table) > CACHE_ENTRIES:
                table.clear()
        for table in (self._totals, self._chunks):
            for w in [w for w in table if len(w) > LONGEST_CHUNK] if self.long else ():
                del table[w]
        self.long = False

    long = False

    def tables(self, texts: list[str]) -> Iterator[PrefixTable]:
        """The stored counts of whole texts."""
        self._forget()
        simple = [not INNER_BLANK.search(t) and not (self.special and any(s in t for s in self.special_heads)) for t in texts]
        chunks = [t.split(" ") if ok else [] for t, ok in zip(texts, simple)]
        new = [c for c in set(chain.from_iterable(cs[1:] for cs in chunks)) if c not in self._chunks]
        self.long = any(len(c) > LONGEST_CHUNK for cs in chunks for c in cs) or not all(simple)
        self._learn_chunks(new)
        known = self._chunks.__getitem__
        for text, ok, cs in zip(texts, simple, chunks):
            if not ok:
                yield PrefixTable(self, text, *self._runs(text))
                continue
            counts = list(accumulate(map(known, cs[1:]), initial=self._plain(cs[0])))
            ends = list(accumulate(map((1).__add__, map(len, cs[1:])), initial=len(cs[0])))
            yield PrefixTable(self, text, ends, counts)

    def _runs(self, text: str) -> tuple[list[int], list[int]]:
        """(ends, counts) after every pre-token and special string."""
        ends, counts, at, total = [0], [0], 0, 0
        for part, special in self._segments(text):
            pieces = [part] if special else self.split.findall(part)
            if not special:
                self.learn([p for p in set(pieces) if p not in self._totals])
            for p in pieces:
                at, total = at + len(p), total + (1 if special else self._totals[p])
                ends.append(at)
                counts.append(total)
        return ends, counts

    def counts(self, texts: list[str]) -> list[int]:
        return [t.total for t in self.tables(texts)]

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def _chars(self, piece: str) -> list[int]:
        """Counts after each character of a pre-token that begins where the pattern puts it."""
        data = piece.encode()
        counts = self.piece_counts(data)
        ends, at = [], 0
        for c in piece:
            at += len(c.encode())
            ends.append(counts[at])
        if piece in CONTRACTIONS:  # its first two characters are two pre-tokens
            ends[1] = self.piece_counts(b"'")[-1] + self.piece_counts(piece[1].encode())[-1]
        return ends

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token count of every character prefix, index 0 to ``len(text)``.

        A run of white space is one pre-token while the prefix ends in it; its last blank joins the word that
        follows. A prefix that ends inside a special string is counted as ordinary text."""
        out, base, before, before_base = [0], 0, "", 0
        for part, special in self._segments(text):
            if special:
                joined = self.prefix_counts_plain(before + part)
                out += [before_base + k for k in joined[len(before) + 1 : -1]] + [base + 1]
                base += 1
                before, before_base = "", base
            else:
                plain = self.prefix_counts_plain(part)
                out += [base + k for k in plain[1:]]
                before, before_base, base = part, base, base + plain[-1]
        return out

    def prefix_counts_plain(self, text: str) -> list[int]:
        out, base, run = [0], 0, None
        for m in self.split.finditer(text):
            piece = m.group()
            head = self.blank.match(piece).end()
            ends = self._chars(piece)
            if run is not None and head:  # goes on the white space before
                so_far = run[0] + piece[:head]
                for k in range(len(run[0]) + 1, len(so_far) + 1):
                    out.append(run[1] + self.piece_counts(so_far[:k].encode())[-1])
                out += [base + k for k in ends[head:]]
            else:
                out += [base + k for k in ends]
            if head == len(piece):
                run = (run[0] + piece, run[1]) if run is not None else (piece, base)
            else:
                run = None
            base += ends[-1]
        return out


class PrefixTable:
    """Exact token counts at the ends of a text's chunks, from which that of any prefix follows."""

    def __init__(self, counter: PrefixCounter, text: str, ends: list[int], counts: list[int]):
        self.counter, self.text, self.ends, self.counts = counter, text, ends, counts

    @property
    def total(self) -> int:
        return self.counts[-1]

    def _clean(self, k: int) -> int:
        """The last end up to number ``k`` at which no white space run and no special string can go on."""
        text, heads = self.text, self.counter.special_heads
        while k >= 0:
            end = self.ends[k]
            if end and not text[end - 1].isspace() and text[end : end + 1] in ("", " ") and not text[end + 1 : end + 2].isspace() and not any(s in text[end - len(s) : end + len(s)] for s in heads):
                return k
            k -= 1
        return -1

    def _start(self, n: int) -> tuple[int, int]:
        """(characters, tokens) up to the last clean end before character ``n``."""
        k = self._clean(bisect_right(self.ends, n) - 1)
        return (self.ends[k], self.counts[k]) if k >= 0 else (0, 0)

    def at(self, n: int) -> int:
        """Tokens of the first ``n`` characters: those up to a clean end, and of the few characters from there."""
        begin, base = self._start(n)
        piece, special = self.text[begin:n], self.counter.special
        return base + (self.counter._plain(piece) if not special or not special.search(piece) else self.counter.prefix_counts(piece)[-1])

    def stored(self, step: int = STEP) -> list[int]:
        """Counts after every ``step`` characters, up to the text's length; a long chunk is gone through once."""
        out: list[int] = []
        places = [(n, *self._start(n)) for n in range(step, len(self.text) + 1, step)]
        for (begin, base), some in groupby(places, key=lambda p: p[1:]):
            ns = [p[0] for p in some]
            if len(ns) == 1:
                out.append(self.at(ns[0]))
            else:
                inside = self.counter.prefix_counts(self.text[begin : ns[-1]])
                out += [base + inside[n - begin] for n in ns]
        return out

    def cut(self, budget: int) -> int:
        """Characters of a longest prefix within the budget: up to the first chunk that passes it, and in that chunk."""
        if self.total <= budget:
            return len(self.text)
        k = bisect_right(self.counts, budget)
        first = self.ends[k - 1] if k else 0
        begin, base = self._start(first)
        inside = self.counter.prefix_counts(self.text[begin : self.ends[k]])
        return max((n for n in range(first, self.ends[k]) if base + inside[n - begin] <= budget), default=first)


def kept_within(stored: list[int], total: int, length: int, budget: int, step: int = STEP) -> int:
    """Characters that stored counts show to be within a budget, without the text: a multiple of ``step``, or all."""
    return length if total <= budget else step * bisect_right(stored, budget)


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> PrefixCounter:
    return PrefixCounter(vocabulary)


def token_counts(docs: DataFrame, vocabulary: str, *, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, UTF-8 bytes, exact tokens, whether over ``limit``, the characters that the budget of
    ``limit`` tokens keeps, and ``prefix_tokens``, the exact counts after every ``STEP`` characters. One pass over the scan's
    partitions, no shuffle; a worker keeps counts of at most ``CACHE_ENTRIES`` chunks."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.claim("token_counts", counter.cache_clear)
        c = counter(vocabulary)
        for b in batches:
            texts, n, cut, stored = b.column("t").to_pylist(), [], [], []
            for at in range(0, len(texts), 1000):
                for t in c.tables(texts[at : at + 1000]):
                    n.append(t.total)
                    cut.append(t.cut(limit))
                    stored.append(t.stored())
            over = pa.array([k > limit for k in n], pa.bool_())
            # The key's column goes through as it is: null ids beside large ones stay what they are.
            columns = [b.column("k"), b.column("n"), pa.array(n, pa.int64()), over, pa.array(cut, pa.int64()), pa.array(stored, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "n_tokens", "over_limit", "kept_chars", "prefix_tokens"])

    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("k"), t.alias("t"), F.octet_length(t).cast("long").alias("n")).mapInArrow(
        run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, kept_chars long, prefix_tokens array<int>"
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict[str, str] = {}
