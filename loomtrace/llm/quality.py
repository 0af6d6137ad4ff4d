"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of terms: its blank-separated words in lower case, the shapes of its words (letters, case, digits and marks with
their runs), and buckets of its repetition and length. Words and the other terms are hashed into tables of fixed
size, weighed by inverse document frequency, and projected on the leading singular vectors of the labelled sample.
The labelled vectors are broadcast (at most ``2 * PER_CLASS`` rows of ``RANK`` numbers); every document's cosines with all of
them are computed in blocks, and its nearest neighbours vote, weighed by similarity and by their class's share.

Defined cases: null text counts as empty and has its own length term; a very long text is read whole; without labels of both
classes every score is the share of label 1 (0.5 without any); repeated rows get equal scores; cosines are compared to nine
digits, and of equal ones at the border of the neighbourhood the earlier labelled row votes; an empty table gives an empty
result; a column of the input that has the name of a new one is replaced by it.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled, shared

#: The bounded sample: rows of each class, and bytes of the longest text that is learned from.
PER_CLASS, LONGEST = 2500, 65_536
#: Slots of shapes and buckets, and slots of words behind them; how much a word's term weighs beside a shape's.
SHAPES, WORDS, WORD_WEIGHT = 2048, 8192, 0.35
SLOTS, RANK, NEIGHBOURS = SHAPES + WORDS, 48, 25
#: Words that a worker remembers at most, and the letters of the longest.
CACHE_ENTRIES, LONGEST_WORD = 500_000, 64
_LETTERS, _CAPITALS, _DIGITS = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")
_RUN = re.compile(r"([^\w])\1+")


def shape(word: str) -> str:
    """Letters and digits as one sign a run, other marks as they are, runs of one mark as the mark and a plus."""
    s = _DIGITS.sub("0", _CAPITALS.sub("X" if word.isupper() and len(word) > 1 else "x", _LETTERS.sub("x", word)))
    return _RUN.sub(r"\1+", re.sub("x+", "x", s))[:12]


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SHAPES


class Bag:
    """Hashed terms of a text; remembers the slots of each word and of its shape."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(slots, values); a slot may come more than once."""
        words = text.split()
        n = len(words)
        counts = Counter(words)
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in [w for w in counts if w not in known]:
            known[w] = _slot("s " + shape(w)) * WORDS + zlib.crc32(w.lower().encode()) % WORDS
        both = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
        if any(len(w) > LONGEST_WORD for w in counts):
            for w in [w for w in counts if len(w) > LONGEST_WORD]:
                del known[w]
        c = np.fromiter(counts.values(), float, len(counts))
        of_shape = np.bincount(both // WORDS, c, SHAPES)
        shapes = np.flatnonzero(of_shape)
        repeat = sum(map(operator.eq, words, words[1:])) / max(n - 1, 1)
        bucket = {"repeat": int(10 * repeat), "distinct": int(10 * len(counts) / max(n, 1)), "top": int(10 * max(counts.values(), default=0) / max(n, 1)), "length": int(np.log2(n + 1))}
        slots = np.r_[shapes, [_slot(f"{k} {v}") for k, v in bucket.items()], SHAPES + both % WORDS].astype(np.int64)
        return slots, np.r_[np.log1p(20.0 * of_shape[shapes] / max(n, 1)), [0.3 if k == "length" else 1.0 for k in bucket], WORD_WEIGHT * np.log1p(20.0 * c / max(n, 1))]


@dataclass
class NeighbourVote:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray  # weight and weight times label of each labelled row
    constant: float | None = None
    bag: Bag = field(default_factory=Bag)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "bag"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"bag": Bag()}

    def project(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.basis.shape[1]), np.float64)
        for i, t in enumerate(texts):
            slots, values = self.bag(t)
            out[i] = (values * self.idf[slots]) @ self.basis[slots]
        return _unit(out)

    def score(self, texts: list[str], block: int = 512) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        k = min(NEIGHBOURS, len(self.vectors))
        out = np.empty(len(texts))
        for at in range(0, len(texts), block):
            cosine = np.round(self.project(texts[at : at + block]) @ self.vectors.T, 9)
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(cosine, near, 1).min(axis=1, keepdims=True)
            for i in np.flatnonzero((cosine >= least).sum(axis=1) > k):  # ties at the border: earlier rows first
                near[i] = np.argsort(-cosine[i], kind="stable")[:k]
            w = np.exp((np.take_along_axis(cosine, near, 1) - 1.0) * 10.0)
            out[at : at + block] = (w * self.votes[near, 1]).sum(axis=1) / (w * self.votes[near, 0]).sum(axis=1)
        return np.round(np.clip(out, 0.0, 1.0), 9)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _singular(bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors of the weighed bags, by subspace iteration; dense only for a block of rows."""

    def blocks() -> Iterable[np.ndarray]:
        for at in range(0, len(bags), 256):
            x = np.zeros((len(bags[at : at + 256]), SLOTS), np.float32)
            for i, (slots, values) in enumerate(bags[at : at + 256]):
                np.add.at(x[i], slots, values * idf[slots])
            yield x

    q = np.random.default_rng(5).standard_normal((SLOTS, min(rank + 12, SLOTS)))
    for _ in range(rounds):
        q = np.linalg.qr(q)[0].astype(np.float32)
        y = np.zeros((SLOTS, q.shape[1]), np.float64)
        for x in blocks():
            y += x.T @ (x @ q)
        q = y
    basis = np.linalg.qr(q)[0]
    projected = np.zeros((basis.shape[1], basis.shape[1]))
    for x in blocks():
        z = x @ basis
        projected += z.T @ z
    values, turn = np.linalg.eigh(projected)
    keep = np.flatnonzero(values[::-1] > 1e-9 * max(values[-1], 1e-300))[:rank]
    return basis @ turn[:, ::-1][:, keep]


def fit(texts: Iterable[str], y: list[int] | np.ndarray, share: float) -> NeighbourVote:
    """Fit on a bounded sample. ``y`` may grow while ``texts`` are read."""
    bag = Bag()
    bags = [bag(t) for t in texts]
    y = np.asarray(y, np.int64)
    if labelled.one_class(y):
        return NeighbourVote(np.ones(SLOTS), np.zeros((SLOTS, 1)), np.zeros((1, 1)), np.ones((1, 2)), constant=share)
    df = np.bincount(np.concatenate([np.unique(s) for s, _ in bags]), minlength=SLOTS)
    idf = np.log((1 + len(bags)) / (1 + df)) + 1.0
    basis = _singular(bags, idf, RANK)
    found = _unit(np.array([(v * idf[s]) @ basis[s] for s, v in bags]))
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return NeighbourVote(idf, basis, found, np.column_stack([w, w * y]))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> NeighbourVote:
    return labelled.fitted(docs, labels, "quality", fit, modulus=3, remainder=1, per_class=per_class, longest=LONGEST, key=key, text=text)


def score(docs: DataFrame, model: NeighbourVote, *, text: str = "text", threshold: float = 0.5, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` with score and predicted behind them (named with ``prefix``). One pass, no shuffle."""

    def run(m: NeighbourVote, texts: list[str]) -> list:
        s = m.score(texts)
        return [s, (s >= threshold).astype("int32")]

    return labelled.scored(docs, {f"{prefix}score": "double", f"{prefix}predicted": "int"}, model, run, operator="quality", forget=lambda m: m.bag.known.clear(), text=text, rows=1024)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, shared.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", labelled.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
