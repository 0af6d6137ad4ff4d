"""Toxic spans by a linear-chain conditional random field over word tokens.

Labelled tokens come from labelled documents: a word of a toxic document counts as toxic if one of its features (the word
or a prefix) is far more frequent in toxic than in other documents of the sample. Features are hashed into a weight table of fixed
size; the field has two states and is fitted by gradient ascent on the exact likelihood of all tokens of the sample, a block of
chunks at a time. Scoring runs
forward and backward over whole texts: each step is a 2 x 2 map of the state odds, so blocks of steps are multiplied
first and the odds at their borders found in order, which keeps the recursion exact and vectorised. Marginals
aggregate to a document score by a logistic function of the largest and the summed marginals; tokens above one half give the offending offsets.

Defined cases: null or wordless text scores as a text without toxic tokens; a very long text is scored whole; without labels
of both classes every score is the share of label 1 (0.5 without any); repeated rows get equal scores; labels of null or other
values are left out; an empty table gives an empty result; a column of the input that has the name of a new one is replaced by it.
Offsets are characters of the text as it stands.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled, shared

#: The bounded sample: rows of each class, and bytes of the longest text that is learned from.
PER_CLASS, LONGEST = 2500, 65_536
SLOTS = 1 << 20
CHUNK = 64
#: Chunks of a block of the fit, and passes over all blocks.
BLOCK, EPOCHS = 1024, 6
#: How likely chance may make a feature look telling, and the least share of toxic texts that have it.
CHANCE, SHARE = 1e-3, 0.01
WORDS = re.compile(r"[^\W\d_]+")
CACHE_ENTRIES = 300_000


def features(word: str) -> list[int]:
    """Slots of the features of a word, in lower case: itself and its prefixes of three to six letters."""
    return [zlib.crc32(n.encode()) % SLOTS for n in names(word.lower())]


def names(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in (3, 4, 5, 6) if len(word) > k)]


def forward_backward(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float, block: int = 64) -> np.ndarray:
    """Marginals of state 1 for chains laid end to end; ``emission`` holds log odds, ``first`` marks where a chain begins,
    ``trans`` the four transition factors [from, to], ``start`` the log odds of a chain's first state."""
    n = len(emission)
    if not n:
        return np.zeros(0)
    e = np.exp(np.clip(emission, -30, 30))
    last = np.r_[first[1:], True]

    def run(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """r[t] = (a + b r[t-1]) / (c + d r[t-1]), in blocks."""
        rows = -(-n // block)
        pad = rows * block - n
        a, b, c, d = (np.concatenate([x, np.full(pad, v)]).reshape(rows, block).T.copy() for x, v in ((a, 0.0), (b, 1.0), (c, 1.0), (d, 0.0)))
        pa, pb, pc, pd_ = a[0], b[0], c[0], d[0]  # the product so far, as (a + b r) / (c + d r)
        for t in range(1, block):
            na, nb, nc, nd = a[t] * pc + b[t] * pa, a[t] * pd_ + b[t] * pb, c[t] * pc + d[t] * pa, c[t] * pd_ + d[t] * pb
            s = 1.0 / (na + nb + nc + nd)
            pa, pb, pc, pd_ = na * s, nb * s, nc * s, nd * s
        into, r = np.empty(rows), 1.0
        for i, (x, y, z, w) in enumerate(zip(pa.tolist(), pb.tolist(), pc.tolist(), pd_.tolist())):
            into[i] = r
            r = (x + y * r) / (z + w * r)
        out = np.empty((block, rows))
        r = into
        for t in range(block):
            r = (a[t] + b[t] * r) / (c[t] + d[t] * r)
            out[t] = r
        return out.T.reshape(-1)[:n]

    one, zero = np.ones(n), np.zeros(n)
    s = np.exp(start)
    forward = run(np.where(first, e * s, e * trans[0, 1]), np.where(first, 0.0, e * trans[1, 1]), np.where(first, one, trans[0, 0]), np.where(first, zero, trans[1, 0]))
    # Backwards over b[t] = (T10 + T11 e[t+1] b[t+1]) / (T00 + T01 e[t+1] b[t+1]); 1 at a chain's end.
    after = np.r_[e[1:], 1.0]
    back = [np.where(last, 1.0, trans[1, 0]), np.where(last, 0.0, trans[1, 1] * after), np.where(last, 1.0, trans[0, 0]), np.where(last, 0.0, trans[0, 1] * after)]
    backward = run(*(x[::-1] for x in back))[::-1]
    odds = forward * backward
    return odds / (1.0 + odds)


@dataclass
class SpanTagger:
    weight: np.ndarray
    trans: np.ndarray
    start: float
    scale: tuple[float, ...]
    constant: float | None = None
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"known": {}}

    def emissions(self, words: list[str]) -> np.ndarray:
        known, weight = self.known, self.weight
        for w in set(words):
            if w not in known:
                known[w] = float(sum(weight[i] for i in features(w)))
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        e = np.concatenate([self.emissions(t) for t in texts]) if texts else np.zeros(0)
        first = np.zeros(len(e), bool)
        first[(ends - lengths)[lengths > 0]] = True
        return np.split(forward_backward(e, first, self.trans, self.start), ends[:-1]) if texts else []

    @staticmethod
    def summary(m: np.ndarray) -> tuple[float, float, float]:
        """Largest marginal, second largest, and log of one plus the sum of those that count."""
        if not len(m):
            return 0.0, 0.0, 0.0
        strong = m[m > 0.05]
        top = np.sort(strong)[::-1][:2] if len(strong) else np.array([m.max()])
        return float(top[0]), float(top[1]) if len(top) > 1 else 0.0, float(np.log1p(strong.sum()))

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(marginals), self.constant)
        x = np.array([self.summary(m) for m in marginals]).reshape(-1, 3)
        return 1.0 / (1.0 + np.exp(-(x @ np.array(self.scale[:3]) + self.scale[3])))


def tokens(text: str) -> list[str]:
    return WORDS.findall(text)


NO_FEATURE = np.uint32(0xFFFFFFFF)


class Sample:
    """The texts of a training sample as word numbers; words keep the hashes of themselves and of their features."""

    def __init__(self, texts: Iterable[str]):
        index: dict[str, int] = {}
        self.docs = [np.fromiter((index.setdefault(w.lower(), len(index)) for w in tokens(t)), np.int32) for t in texts]
        self.hashes = np.fromiter((zlib.crc32(w.encode()) for w in index), np.uint32, len(index))
        self.features = np.full((len(index), 5), NO_FEATURE, np.uint32)
        for i, w in enumerate(index):
            found = [zlib.crc32(n.encode()) for n in names(w)]
            self.features[i, : len(found)] = found

    def distinct(self) -> list[int]:
        """Texts that are no near copies of an earlier one: copies would make the words that they share look telling.
        Two texts count as copies if one of three triples of their smallest word hashes agrees."""
        seen: set[tuple] = set()
        kept = []
        for i, words in enumerate(self.docs):
            low = np.unique(self.hashes[words])[:9].tolist()
            keys = {(k, *low[k : k + 3]) for k in (0, 3, 6) if len(low) >= k + 3} or {tuple(low)}
            if not keys & seen:
                kept.append(i)
            seen |= keys
        return kept

    def toxic_words(self, which: list[int], y: np.ndarray) -> np.ndarray:
        """For each word, whether it counts as toxic where it stands in a toxic document."""
        counts = []
        for label in (0, 1):
            sets = [np.unique(self.features[np.unique(self.docs[i])]) for i, k in zip(which, y) if k == label]
            counts.append(np.unique(np.concatenate(sets), return_counts=True))
        (f0, c0), (f1, c1) = counts
        n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
        at = np.minimum(np.searchsorted(f0, f1), len(f0) - 1)
        clean = np.where(f0[at] == f1, c0[at], 0)
        # Far more frequent among toxic texts, and by more than chance allows: Chernoff's bound of the binomial tail.
        n, rate = c1 + clean, n1 / (n1 + n0)
        x = c1 / n
        excess = n * (x * np.log(x / rate) + np.where(x < 1, (1 - x) * np.log(np.maximum(1 - x, 1e-12) / (1 - rate)), 0.0))
        telling = f1[(c1 >= SHARE * n1) & (x > rate) & (excess >= -np.log(CHANCE)) & (c1 / n1 >= 15 * (clean + 0.5) / n0) & (f1 != NO_FEATURE)]
        return np.isin(self.features, telling).any(axis=1)


class Block:
    """Chunks of tagged words, with the features of the words in them."""

    def __init__(self, rows: list[np.ndarray], tags: list[np.ndarray], sample: Sample):
        n = len(rows)
        ids, self.t, self.mask = np.zeros((n, CHUNK), np.int32), np.zeros((n, CHUNK), bool), np.zeros((n, CHUNK), bool)
        for r, (row, tag) in enumerate(zip(rows, tags)):
            ids[r, : len(row)], self.t[r, : len(row)], self.mask[r, : len(row)] = row, tag, True
        used, place = np.unique(ids[self.mask], return_inverse=True)
        self.x = np.zeros((n, CHUNK), np.int32)  # 0 stands for no word
        self.x[self.mask] = place + 1
        some = sample.features[used]
        self.owner, column = np.nonzero(some != NO_FEATURE)
        self.slots, self.local = np.unique((some[self.owner, column] % SLOTS).astype(np.int64), return_inverse=True)
        self.owner, self.words = self.owner + 1, len(used) + 1
        self.pairs = np.array([[(self.mask[:, 1:] & (self.t[:, :-1] == a) & (self.t[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)

    def gradient(self, weight: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log likelihood by the weights of this block's slots, the log transition factors and the start, by exact
        forward and backward passes over all chunks side by side."""
        x, mask = self.x, self.mask
        emission = np.bincount(self.owner, weights=weight[self.slots][self.local], minlength=self.words)
        e = np.exp(np.clip(emission[x], -30, 30))
        T = np.exp(trans)
        f1 = np.empty(x.shape)
        f1[:, 0] = e[:, 0] * np.exp(start)
        for k in range(1, CHUNK):  # odds of the states, going forward
            r = f1[:, k - 1]
            f1[:, k] = e[:, k] * (T[0, 1] + T[1, 1] * r) / (T[0, 0] + T[1, 0] * r)
        b1 = np.ones(x.shape)
        for k in range(CHUNK - 2, -1, -1):
            v = e[:, k + 1] * b1[:, k + 1]
            b1[:, k] = np.where(mask[:, k + 1], (T[1, 0] + T[1, 1] * v) / (T[0, 0] + T[0, 1] * v), 1.0)
        odds = f1 * b1
        m = np.where(mask, odds / (1 + odds), 0.0)
        per_word = np.bincount(x.ravel(), weights=np.where(mask, self.t - m, 0.0).ravel(), minlength=self.words)
        right = (np.ones_like(b1[:, 1:]), e[:, 1:] * b1[:, 1:])
        left = (np.ones_like(f1[:, :-1]), f1[:, :-1])
        joint = np.array([[T[a, b] * left[a] * right[b] for b in (0, 1)] for a in (0, 1)])
        joint /= joint.sum(axis=(0, 1))
        expected = np.where(mask[:, 1:], joint, 0.0).sum(axis=(2, 3))
        return np.bincount(self.local, weights=per_word[self.owner], minlength=len(self.slots)), self.pairs - expected, float((self.t[:, 0] - m[:, 0]).sum())


def fit(texts: Iterable[str], y: list[int] | np.ndarray, share: float) -> SpanTagger:
    """Fit the field and the document scale on a bounded sample. ``y`` may grow while ``texts`` are read."""
    none = SpanTagger(np.zeros(SLOTS, np.float32), np.ones((2, 2)), 0.0, (0.0,) * 4, constant=share)
    sample = Sample(texts)
    y = np.asarray(y, np.int64)
    if labelled.one_class(y):
        return none
    alone = sample.distinct()
    y = y[alone]
    if labelled.one_class(y):
        return none
    toxic = sample.toxic_words(alone, y)
    rows, tags = [], []
    for i, label in zip(alone, y):
        ids = sample.docs[i]
        hit = toxic[ids] & bool(label)
        rows += [ids[at : at + CHUNK] for at in range(0, len(ids), CHUNK)]
        tags += [hit[at : at + CHUNK] for at in range(0, len(ids), CHUNK)]
    order = np.random.default_rng(17).permutation(len(rows)).tolist()
    blocks = [Block([rows[i] for i in order[at : at + BLOCK]], [tags[i] for i in order[at : at + BLOCK]], sample) for at in range(0, len(order), BLOCK)]
    del rows, tags
    weight, trans, start = np.zeros(SLOTS), np.zeros((2, 2)), -3.0
    sq_w, sq_t, sq_s = np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(max(EPOCHS, 30 // max(1, len(blocks)))):
        for block in blocks:
            g, gt, gs = block.gradient(weight, trans, start)
            at = block.slots
            g, gt = g - 0.05 / len(blocks) * weight[at], gt - 0.1 / len(blocks) * trans
            sq_w[at] += g * g
            sq_t, sq_s = sq_t + gt * gt, sq_s + gs * gs
            weight[at] += 0.6 * g / np.sqrt(sq_w[at])
            trans, start = trans + 0.3 * gt / np.sqrt(sq_t), start + 0.3 * gs / np.sqrt(sq_s)
    del blocks
    table = weight.astype(np.float32)
    tagger = SpanTagger(table, np.exp(trans), float(start), (0.0,) * 4)
    emission = np.where(sample.features != NO_FEATURE, table[sample.features % SLOTS], 0).sum(axis=1, dtype=float)
    s = np.empty((len(alone), 3))
    for k, i in enumerate(alone):
        first = np.zeros(len(sample.docs[i]), bool)
        first[:1] = True
        s[k] = tagger.summary(forward_backward(emission[sample.docs[i]], first, tagger.trans, tagger.start))
    design = np.column_stack([s, np.ones(len(s))])
    # Classes are weighed back to their share among all labelled rows.
    w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    beta = np.zeros(4)
    ridge = np.diag([0.5, 0.5, 0.5, 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        beta += np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (w * (y - p)) - ridge @ beta)
    tagger.scale = tuple(beta.tolist())
    return tagger


def spans(text: str, m: np.ndarray) -> list[dict[str, int]]:
    """Offsets of runs of neighbouring tokens whose marginal is above one half, in characters of the text."""
    out: list[dict[str, int]] = []
    before = -2
    for k, match in enumerate(WORDS.finditer(text)):
        if m[k] > 0.5:
            if before == k - 1:
                out[-1]["end"] = match.end()
            else:
                out.append({"start": match.start(), "end": match.end()})
            before = k
    return out


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> SpanTagger:
    return labelled.fitted(docs, labels, "toxic", fit, modulus=4, remainder=2, per_class=per_class, longest=LONGEST, key=key, text=text)


def score(docs: DataFrame, tagger: SpanTagger, *, text: str = "text", threshold: float = 0.3, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` with score, predicted and spans behind them (named with ``prefix``). One pass, no shuffle."""

    def run(tagger: SpanTagger, texts: list[str]) -> list:
        found = tagger.marginals([tokens(t) for t in texts])
        s = tagger.scores(found)
        return [s, (s >= threshold).astype("int32"), [spans(t, m) if len(m) and m.max() > 0.5 else [] for t, m in zip(texts, found)]]

    names = {f"{prefix}score": "double", f"{prefix}predicted": "int", f"{prefix}spans": "array<struct<start:int,end:int>>"}
    return labelled.scored(docs, names, tagger, run, operator="toxicity", forget=lambda m: m.known.clear(), text=text, rows=500)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    tagger = train(docs, shared.table(spark, sf_dir, "labels"))
    return score(docs, tagger).select("doc_id", labelled.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted", "spans")


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
