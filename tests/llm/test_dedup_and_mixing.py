import random
from collections import Counter

import numpy as np
import pytest

from loomtrace.llm import mixing, simhash_dedup, suffix_array, suffix_dedup


def reach(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def some_prints(seed, centres, most):
    rng = np.random.default_rng(seed)
    base = (rng.integers(0, 2**63, centres, dtype=np.uint64) * np.uint64(2)).tolist()
    prints = {0, 1, 2**64 - 1, *base}
    for x in base:
        for flips in range(1, most + 1):
            prints.add(x ^ sum(1 << k for k in rng.choice(64, flips, replace=False).tolist()))
    return np.array(sorted(prints), np.uint64)


def check_links(spark, u, radius, **how):
    links = simhash_dedup.near_links(spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long"), n=len(u), radius=radius, **how).toPandas()
    at = {int(x): i for i, x in enumerate(u.view(np.int64))}
    apart = np.bitwise_count(u[:, None] ^ u[None, :])
    want = reach(len(u), np.argwhere(np.triu(apart <= radius, 1)).tolist())
    assert reach(len(u), [(at[a], at[b]) for a, b in zip(links.a, links.b)]) == want


@pytest.mark.parametrize("bits, full, most", [(6, 1 << 23, 1 << 21), (8, 1 << 23, 64), (12, 1 << 23, 1 << 21), (12, 3000, 1 << 21)])
def test_near_links_find_every_pair_within_four_bits(spark, bits, full, most):
    """Also where a task splits its variants, and where the shuffle deals those of full heads by further bits."""
    check_links(spark, some_prints(bits, 25, 6), 4, bits=bits, full=full, most=most)


@pytest.mark.parametrize("radius", [0, 2, 6])
def test_near_links_of_other_radii(spark, radius):
    check_links(spark, some_prints(radius, 8, 8), radius, bits=8)


def test_radii_that_cannot_be_halved_raise(spark):
    with pytest.raises(ValueError):
        simhash_dedup.near_links(spark.createDataFrame([], "fp long"), n=0, radius=3)


def test_a_dense_head_takes_bounded_memory():
    """10,000 fingerprints within three bits of one centre, all of one head: 14 million variants, made two million at a time."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    u = np.array(sorted({centre ^ sum(1 << k for k in rng.choice(52, 3, replace=False).tolist()) for _ in range(10_000)}), np.uint64)
    head = np.full(len(u), u[0] >> np.uint64(52))
    made = [len(a) for a, _ in simhash_dedup._meetings(head, np.arange(len(u)), u, 12, 2, simhash_dedup.AT_ONCE)]
    assert max(made) <= simhash_dedup.AT_ONCE < sum(made)
    # Three bits from one centre: any two within four bits share one of the three, and all hang together.
    a, b = simhash_dedup.meet(head, u, 12)
    assert len(set(a.tolist())) == 1 and len(b) == len(u) - 1


def test_near_duplicates_by_other_shingles_and_radius(spark):
    """The parameters reach the fingerprints and the links: components are those of a brute force with the same ones."""
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for edits in (0, 1, 2, 4):
            changed = list(words)
            for k in rng.sample(range(60), edits):
                changed[k] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(changed))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for words, radius in ((2, 4), (5, 6)):
        prints = [simhash_dedup.fingerprint(t.encode(), words) for t in texts]
        want = reach(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= radius])
        got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs, words_per_shingle=words, radius=radius).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_fingerprint_definition():
    import xxhash

    assert simhash_dedup.fingerprint(b"  \n") == 0
    assert simhash_dedup.fingerprint(b"Only THREE words") == xxhash.xxh64_intdigest(b"only three words", 42)
    words = b"a b c d e f".split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(3)]
    assert simhash_dedup.fingerprint(b"A b\tc d\ne  F") == sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > 3)


def test_near_duplicates_on_odd_rows(spark, odd_docs, no_docs):
    got = simhash_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[5].component_id == by[6].component_id == 5
    assert by[4].component_id == 4 and by[None].component_id is None
    assert simhash_dedup.near_duplicates(no_docs).count() == 0


def covered_by_brute_force(contexts, least):
    where = {}
    for c, t in enumerate(contexts):
        for i in range(len(t) - least + 1):
            where.setdefault(t[i : i + least], []).append((c, i))
    out = [set() for _ in contexts]
    for places in where.values():
        if len(places) > 1:
            for c, i in places:
                out[c].update(range(i, i + least))
    return out


def test_maximal_repeats_cover_what_brute_force_covers():
    rng = random.Random(1)
    for _ in range(400):
        letters = rng.choice([b"ab", b"abc", b"a", bytes(range(97, 117))])
        base = bytes(rng.choice(letters) for _ in range(60))
        contexts = []
        for _ in range(rng.randint(1, 7)):
            s = rng.randint(0, 40)
            t = bytearray(base[s : s + rng.randint(0, 40)])
            if t and rng.random() < 0.6:
                t[rng.randrange(len(t))] = rng.choice(letters)
            contexts.append(bytes(t))
        for least in (6, 10):
            got = [set() for _ in contexts]
            for length, owner, offset in suffix_array.maximal_repeats(contexts, least):
                room = [len(contexts[c]) - i for c, i in zip(owner.tolist(), offset.tolist())]
                for k, (c, i) in enumerate(zip(owner.tolist(), offset.tolist())):
                    got[c].update(range(i, i + min(length, room[k], max(room[:k] + room[k + 1 :]))))
            assert got == covered_by_brute_force(contexts, least)


def test_intervals_form_the_prefix_tree():
    words = sorted(["banana"[i:] for i in range(6)])
    shared = [0] + [next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(words, words[1:])]
    assert sorted(suffix_array.intervals(shared, 1)) == [(1, 0, 3), (2, 4, 6), (3, 1, 3)]


@pytest.mark.parametrize("kinds", [2, 512])
def test_remove_repeats_equals_brute_force(spark, odd_docs, kinds):
    rng = random.Random(kinds)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for p in passage:
            if rng.random() < 0.5:
                cut = rng.choice([0, 0, 30, 100])
                parts += [p[cut:], " ".join(word() for _ in range(rng.randint(0, 20)))]
        rows.append((i, " ".join(parts)))
    rows += [(None, rows[1][1] + " one"), (None, rows[2][1])] + [(95, "".join(rng.choice("pqrst") for _ in range(300)))] * 6
    rows += [(90, "z" * 450), (91, "z" * 199), (92, ""), (93, None), (94, rows[0][1]), (94, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text").where("doc_id <> 8 or doc_id is null"))
    got = Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs, shard_kinds=kinds).collect())
    plain = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = Counter()
    for (i, t), cover in zip(plain, covered_by_brute_force([t for _, t in plain], 200)):
        runs = sum(1 for k in cover if k - 1 not in cover)
        want[i, bytes(b for k, b in enumerate(t) if k not in cover), len(t), len(cover), runs] += 1
    assert got == want


def test_remove_repeats_of_no_rows(spark, no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_mixing_reaches_targets(spark, odd_docs, no_docs):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 5, 20, 300, 4000]), rng.choice(["s0"] * 6 + ["s1", "s2", "Z", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(zip(m.doc_id, m.taken)) == sorted(zip(again.doc_id, again.taken))
    total, targets = m["size"].sum(), {}
    m["source"] = [s if isinstance(s, str) else "\uffff" for s in m.source]  # null is the last source
    for k, (s, g) in enumerate(sorted(m.groupby("source"), key=lambda x: x[0])):
        size = g["size"].sum()
        assert (g.source_size == size).all() and (g.taken <= 3 * g["size"]).all()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2
        targets[s] = (size, g.target.iloc[0], (5, 2, 1)[k % 3])
    assert abs(sum(t for _, t, _ in targets.values()) - total) < 1e-6 * total
    level = {t / w for size, t, w in targets.values() if t < 3 * size - 1e-6}
    assert max(level) - min(level) < 1e-6 and all(3 * size / w <= min(level) + 1e-6 for size, t, w in targets.values() if t >= 3 * size - 1e-6)
    alike = spark.range(1_000_000).selectExpr("cast(null as long) AS doc_id", "'two words' AS text", "if(id < 900000, 'a', 'b') AS source")
    told = {r.source: r for r in mixing.mix(alike).groupBy("source").agg({"taken": "sum", "copies": "max", "*": "count", "target": "max"}).collect()}
    assert [told[s]["count(1)"] for s in "ab"] == [900_000, 100_000] and all(abs(r["sum(taken)"] - r["max(target)"]) <= 2 and r["max(copies)"] <= 3 for r in told.values())
    odd = mixing.mix(odd_docs).toPandas()
    assert len(odd) == odd_docs.count() and (odd.taken <= 3 * odd["size"]).all()
    assert mixing.mix(no_docs).count() == 0


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(0, 5000, 400).astype(float))[::-1]
    p = np.full(400, 0.37)
    q = mixing.flight(p, size, random.Random(1), 3)
    assert ((q > 0) & (q < 1)).sum() <= 3
    assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ size - p @ size) < 1e-3
    r = mixing.landing(q, size)
    assert set(np.unique(r)) <= {0.0, 1.0}
