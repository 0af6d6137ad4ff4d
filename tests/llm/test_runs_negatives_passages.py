import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from loomtrace.llm import hard_negatives, periodic_runs, substring_dedup
from loomtrace.llm.suffix_automaton import SuffixAutomaton, factors

BIG = 2**53 + 1
SMALL = "/root/testdata/sf0.001"


def runs_by_definition(w, least, times):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


def pieced(rng, letters, most):
    w = []
    for _ in range(rng.randint(1, 6)):
        w += [rng.randrange(letters) for _ in range(rng.randint(1, 8))] * rng.randint(1, 5)
        if rng.random() < 0.4:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randint(1, 40)]
    return w[: rng.randint(1, most)]


def test_factors_are_the_longest_that_begin_earlier():
    rng = random.Random(5)
    for _ in range(300):
        w = pieced(rng, rng.choice([1, 2, 4]), 60)
        at = 0
        for begin, size, source in factors(w):
            assert begin == at
            longest = max((next((k for k in range(len(w) - at) if w[s + k] != w[at + k]), len(w) - at) for s in range(at)), default=0)
            assert size == max(longest, 1) and (source < 0) == (longest == 0)
            assert source < 0 or w[source : source + size] == w[at : at + size]
            at += size
        assert at == len(w)


@pytest.mark.parametrize("times", [2, 3])
def test_runs_are_those_of_the_definition(times):
    rng = random.Random(times)
    for _ in range(1500):
        w, least = pieced(rng, rng.choice([1, 2, 3, 4]), 110), rng.choice([2, 3, 4, 6, 8])
        want = runs_by_definition(w, least, times)
        assert periodic_runs.runs_of(w, least=least, times=times) == want
        assert periodic_runs.runs_of_text([b"%d" % x for x in w], least=least, times=times) == want


def test_runs_of_long_texts_take_linear_time():
    rng = random.Random(1)
    w = [b"%d" % rng.randrange(5000) for _ in range(20_000)]
    began = time.time()
    assert periodic_runs.runs_of_text(w * 10) == [(0, 200_000, 20_000)]
    assert periodic_runs.runs_of_text([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert time.time() - began < 20


def test_runs_of_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(BIG, "x y " * 30, None, None, None, None, None), (BIG + 2, "z " * 24, None, None, None, None, None)], odd_docs.schema))
    got = periodic_runs.find_runs(docs, keep=("source",)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    by = {r.doc_id: r for r in got}
    assert [tuple(r) for r in by[BIG].runs] == [(0, 60, 2)] and by[BIG].collapsed == "x y"
    assert [tuple(r) for r in by[BIG + 2].runs] == [(0, 24, 1)] and by[BIG + 2].collapsed == "z"
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[3].collapsed == "" and by[1].runs == []
    assert [tuple(r) for r in by[5].runs] == [(0, 120, 10)] and by[5].collapsed == "the same words stand here twice over and over again"
    assert by[8].n_words == 60_000
    assert periodic_runs.find_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, keep=("Runs",))


def test_op11_by_its_definition(spark):
    got = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        ids = {}
        x = np.array([ids.setdefault(t, len(ids)) for t in w], np.int64)
        found = {}
        for q in range(1, n // 3 + 1):
            e = np.flatnonzero(np.diff(np.r_[0, (x[q:] == x[:-q]).astype(np.int8), 0]))
            for s, t in zip(e[::2].tolist(), e[1::2].tolist()):
                if t + q - s >= max(24, 3 * q):
                    found.setdefault((s, t + q), q)
        runs = sorted((s, t - s, q) for (s, t), q in found.items())
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        r = got[d.doc_id]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % t for t in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(t for i, t in enumerate(w) if i not in gone)).hexdigest()
        if runs:
            s, size, q = min(runs, key=lambda t: (-t[1] / t[2], t[0], t[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, size, q, 1000 * size // q)
        else:
            assert r.start is r.length is r.period is r.exponent_milli is None
    assert planted > 10 and sum(r.n_runs > 0 for r in got.values()) > planted // 3


def mined_by_brute_force(rows, every, positives, negatives, low, high):
    fit = [(k, i, np.floor(256 * np.array(v, float)).astype(object), lab) for k, (i, v, lab) in enumerate(rows) if None not in (i, v, lab) and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for k, i, q, lab in fit:
        if i % every == 0:
            s = [(-int(sum(int(a) * int(b) for a, b in zip(q, v))), j, m, lb) for m, j, v, lb in fit if m != k and len(v) == len(q)]
            for p in sorted(t[:2] for t in s if t[3] == lab)[:positives]:
                ok = sorted(t[:2] for t in s if t[3] != lab and -low * p[0] <= -100 * t[0] <= -high * p[0])
                out += [(i, p[1], r, n[1], -p[0], -n[0]) for r, n in enumerate(ok[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, group, pivots", [(16_384, 4096, 8), (7, 3, 5), (64, 2, 1)])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, block, group, pivots):
    for name, value in (("BLOCK_ROWS", block), ("GROUP_ROWS", group), ("PIVOTS", pivots)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(4, 6))
    rows = [(int(i), [float(x) for x in centres[i % 4] + rng.normal(size=6) * 0.4], int(rng.integers(0, 3))) for i in range(240)]
    rows += [rows[0], rows[10], rows[11], (20, rows[3][1], 1), (30, None, 1), (40, [1.0, None, 2.0, 1.0, 1.0, 1.0], 1), (50, [float("nan")] * 6, 0), (60, rows[4][1], None), (None, rows[5][1], 1), (70, [1.0, 2.0], 0), (80, [1.5, 2.0], 0), (81, [0.5, 1.0], 1), (90, [], 2), (91, [], 1), (100, [0.0] * 6, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as row", "1 as cell", "2 as id")
    got = sorted(tuple(r)[:6] for r in hard_negatives.mine(frame, every=10, positives=3, negatives=4).collect())
    assert got == mined_by_brute_force(rows, 10, 3, 4, 30, 90)
    assert len(got) > 100


def test_hard_negatives_of_large_components_ids_and_empty_tables(spark):
    kind = "vec_id long, embedding array<double>, label int"
    rows = [(100 * 2**52, [1e7, 1e6], 0), (100 * 2**52 + 1, [1e7, 1.5e6], 0), (100 * 2**52 + 3, [7e6, 1e6], 1), (7, [4e6, 0.0], 2)]
    got = sorted(tuple(r)[:6] for r in hard_negatives.mine(spark.createDataFrame(rows, kind)).collect())
    assert got == mined_by_brute_force(rows, 100, 5, 10, 30, 90) and got[0][0] == 100 * 2**52
    assert hard_negatives.mine(spark.createDataFrame([], kind)).count() == 0


def words_by_brute_force(texts, window):
    words = [(t or "").encode().split() for t in texts]
    where = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            where.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = {(d, j) for places in where.values() if len(places) > 1 for d, i in places for j in range(i, i + window)}
    return [(len(w), sum((d, i) in gone for i in range(len(w))), b" ".join(t for i, t in enumerate(w) if (d, i) not in gone).decode()) for d, w in enumerate(words)]


def passages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 2)
    passage = [[word() for _ in range(rng.randint(8, 60))] for _ in range(6)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [word() for _ in range(rng.randint(0, 30))]
            p = rng.choice(passage)
            w += p[rng.randrange(4) : len(p) - rng.randrange(4)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    return [*texts, *texts[:4], "a " * 90, "a  " * 50, None, "", " "]


@pytest.mark.parametrize("window, kinds", [(12, 512), (12, 2), (35, 512), (9, 1)])
def test_repeated_passages_are_those_of_brute_force(spark, monkeypatch, window, kinds):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 200)
    texts = passages(window + kinds)
    docs = spark.createDataFrame([(BIG + 2 * i if i % 9 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, at int")
    got = {r["at"]: r for r in substring_dedup.remove_repeats(docs, window=window, keep=("at",), shard_kinds=kinds).collect()}
    want = words_by_brute_force(texts, window)
    assert [(got[i].n_words, got[i].n_removed, got[i].kept) for i in range(len(texts))] == want
    assert [got[i].doc_id for i in range(len(texts))] == [BIG + 2 * i if i % 9 else None for i in range(len(texts))]
    assert sum(w[1] > 0 for w in want) > 20


def test_known_passages_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE_WORDS", 30)
    texts, known = passages(3), passages(4)[:20] + passages(3)[:7] + [None, "", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_known(docs, spark.createDataFrame([(t,) for t in known], "text string"), window=12, pass_words=200).collect()}
    held = {tuple(w[i : i + 12]) for w in ((t or "").split() for t in known) for i in range(len(w) - 11)}
    for d, t in enumerate(texts):
        w = (t or "").split()
        gone = {j for i in range(len(w) - 11) if tuple(w[i : i + 12]) in held for j in range(i, i + 12)}
        assert (got[d].n_words, got[d].n_removed, got[d].kept) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    nothing = substring_dedup.remove_known(docs, spark.createDataFrame([], "text string"), window=12)
    assert nothing.where("n_removed > 0").count() == 0 and nothing.count() == len(texts)


def test_passages_of_odd_rows(spark, odd_docs, no_docs):
    got = substring_dedup.remove_repeats(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[5].n_removed == by[6].n_removed == 120 and by[5].kept == "" and by[4].kept == "one"
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0
    assert by[8].n_removed > 1000 and by[8].n_words == 60_000
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(odd_docs, keep=("kept",))


def test_op13_by_its_definition(spark):
    got = {r.doc_id: r for r in substring_dedup.op13_substring_dedup(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = words_by_brute_force([d.text for d in docs], 35)
    for d, (n, gone, kept) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_matching_statistics():
    automaton = SuffixAutomaton([[1, 2, 3, 1, 2], [2, 3, 4]])
    assert [m for m, _ in automaton.matching_statistics([1, 2, 3, 4, 9, 3, 1, 2, 2])] == [1, 2, 3, 3, 0, 1, 2, 3, 1]


def test_hard_negatives_of_far_clusters_are_not_sought_elsewhere(spark, monkeypatch):
    """Where clusters lie far apart, bounds keep most candidates from most groups."""
    rng = np.random.default_rng(2)
    centres = 40 * np.eye(6)
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=6) * 0.1], i // 6 % 2) for i in range(600)]
    sent, real = [], hard_negatives._served
    monkeypatch.setattr(hard_negatives, "_served", lambda cells, groups, same, home: (sent.append((home, real(cells, groups, same, home).count(), cells.count() * groups.count())), real(cells, groups, same, home))[1])
    got = sorted(tuple(r)[:6] for r in hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every=10, positives=2, negatives=2, low=90, high=100).collect())
    assert got == mined_by_brute_force(rows, 10, 2, 2, 90, 100) and got
    assert sum(n for home, n, _ in sent if not home) < sum(n for home, _, n in sent if not home) / 2
