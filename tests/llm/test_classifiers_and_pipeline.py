import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtrace.llm import labelled, mixing, quality, registry, shared, simhash_dedup, toxicity

from .test_dedup_and_mixing import covered_by_brute_force, reach


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths = [1, 3, 5, 2]
    trans, start = np.exp(rng.normal(size=(2, 2))), 0.3
    emission = rng.normal(size=sum(lengths)) * 2
    first = np.zeros(sum(lengths), bool)
    first[np.r_[0, np.cumsum(lengths)[:-1]]] = True
    got = toxicity.forward_backward(emission, first, trans, start, block=4)
    at = 0
    for n in lengths:
        total, on = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(start * y[0] + emission[at : at + n] @ np.array(y)) * np.prod([trans[a, b] for a, b in zip(y, y[1:])])
            total += w
            on += w * np.array(y)
        assert np.allclose(got[at : at + n], on / total)
        at += n
    assert len(toxicity.forward_backward(np.zeros(0), np.zeros(0, bool), trans, start)) == 0


def made(n, seed, bad):
    """Texts of made-up words; those of label 1 hold a few words of their own kind."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeiourstln"), rng.integers(2, 8)))
    texts, y = [], rng.integers(0, 2, n)
    for label in y:
        words = [word() for _ in range(rng.integers(5, 120))]
        if label:
            for _ in range(rng.integers(1, 6)):
                words.insert(rng.integers(0, len(words)), rng.choice(bad) + str(rng.choice(["", "x", "zz"])))
        texts.append(" ".join(words))
    return texts, y


def test_tagger_learns_words_and_offsets():
    texts, y = made(800, 1, ["grobbel", "wumpf"])
    tagger = toxicity.fit(texts[:500], y[:500], float(y.mean()))
    held = [toxicity.tokens(t) for t in texts[500:]]
    marginals = tagger.marginals(held)
    assert ((tagger.scores(marginals) >= 0.3) == y[500:]).mean() > 0.95
    for t, m in zip(texts[500:520], marginals):
        for s in toxicity.spans(t, m):
            assert all(w.startswith(("grobbel", "wumpf")) for w in t[s["start"] : s["end"]].split())
    odd = "\u0130\u0130 \u00df Grobbel GROBBEL plain"  # lower-casing all of it would move the offsets
    assert toxicity.spans(odd, np.array([0.1, 0.1, 0.9, 0.9, 0.1])) == [{"start": 5, "end": 20}] and odd[5:20] == "Grobbel GROBBEL"
    m = tagger.marginals([toxicity.tokens(odd)])[0]
    assert m[2] > 0.5 and m[3] > 0.5
    assert toxicity.fit(["a"], np.array([1]), 0.4).scores([np.zeros(0)]).tolist() == [0.4]


def test_votes_learn_shapes():
    rng = np.random.default_rng(2)
    texts, y = made(500, 3, ["a"])
    texts = [t if label else " ".join(w + str(rng.choice(["###", "$$$"])) for w in t.split()) for t, label in zip(texts, y)]
    model = quality.fit(texts[:300], y[:300], float(y.mean()))
    assert ((model.score(texts[300:]) >= 0.5) == y[300:]).mean() > 0.97
    assert 0 <= model.score([""])[0] <= 1


def test_votes_learn_words():
    """Texts of equal shapes that differ in their words alone."""
    rng = np.random.default_rng(7)
    kinds = [["alpha", "gamma", "delta", "kappa"], ["omega", "sigma", "theta", "lambd"]]
    y = rng.integers(0, 2, 400)
    texts = [" ".join(rng.choice(kinds[k] + ["other", "plain"], rng.integers(20, 60))) for k in y]
    model = quality.fit(texts[:250], y[:250], float(y.mean()))
    assert ((model.score(texts[250:]) >= 0.5) == y[250:]).mean() > 0.97


def test_votes_equal_brute_force():
    texts, y = made(200, 5, ["grobbel", "wumpf"])
    texts[20:60] = [texts[20]] * 40  # more ties than neighbours
    model = quality.fit(texts, y, 0.4)
    project = model.project(texts)
    for text, got in zip([*texts[:30], "", "x" * 500], model.score([*texts[:30], "", "x" * 500])):
        v = model.project([text])[0]
        cosines = [round(float(v @ w), 9) for w in model.vectors]
        near = sorted(range(len(cosines)), key=lambda i: (-cosines[i], i))[: quality.NEIGHBOURS]
        weight = [np.exp(10 * (cosines[i] - 1)) * (0.4 / y.mean() if y[i] else 0.6 / (1 - y.mean())) for i in near]
        assert abs(got - sum(w * y[i] for w, i in zip(weight, near)) / sum(weight)) < 1e-6
    assert np.allclose(np.linalg.norm(project, axis=1), 1)


def test_clashing_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", {"x": [1]}, "mine")], "doc_id long, text string, tags map<string,array<int>>, Score string")
    got = quality.score(docs, quality.fit(["a"], [1], 0.25))
    assert got.columns == ["doc_id", "text", "tags", "score", "predicted"] and got.first().score == 0.25 and got.first().tags == {"x": [1]}


def test_held_out_rule(spark):
    d = spark.range(200).select("id", labelled.held_out(F.col("id"), 4, 2).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in d.collect())


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_on_odd_rows(spark, odd_docs, no_docs, small, module, label):
    docs = shared.table(spark, small, "documents").select("doc_id", "text")
    model = module.train(docs, shared.table(spark, small, "labels"))
    got = module.score(odd_docs, model, prefix="my_").collect()
    assert len(got) == odd_docs.count() and all(0 <= r.my_score <= 1 for r in got)
    assert len({r.my_score for r in got if r.doc_id in (1, 2)}) == 1
    assert module.score(no_docs, model, prefix="my_").count() == 0
    none = module.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.my_score for r in module.score(odd_docs, none, prefix="my_").collect()} == {0.5}


@pytest.mark.parametrize("name, label, modulus, remainder", [("op2_toxicity", "toxic", 4, 2), ("op4_quality", "quality", 3, 1)])
def test_held_out_accuracy(spark, name, label, modulus, remainder):
    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES[name](spark, sf).join(shared.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % modulus == remainder for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) > 0.9


def _written(spark, docs, name):
    path = shared.new_path(spark, f"test-{name}")
    docs.write.parquet(path)
    return spark.read.parquet(path)


def test_pipeline_stages(spark, odd_docs, small):
    """What every stage keeps, by content."""
    columns = corpus_pipeline.COLUMNS
    tuples = lambda d: Counter(tuple(r[c] for c in columns) for r in d.collect())
    docs = _written(spark, odd_docs, "docs")
    stages = dict(corpus_pipeline.STAGES)

    clean = _written(spark, stages["toxicity"](spark, docs, small), "clean")
    tagger = toxicity.train(docs, shared.table(spark, small, "labels"))
    want = Counter()
    for r in docs.collect():
        if tagger.scores(tagger.marginals([toxicity.tokens(r.text or "")]))[0] < 0.3:
            want[tuple(r[c] for c in columns)] += 1
    assert clean.columns == list(columns) and tuples(clean) == want

    alone = _written(spark, stages["simhash_near_dedup"](spark, clean, small), "alone")
    rows = sorted(clean.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    prints = [simhash_dedup.fingerprint((r.text or "").encode(), corpus_pipeline.SHINGLE) for r in rows]
    roots = reach(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    assert alone.columns == list(columns) and tuples(alone) == Counter(tuple(rows[i][c] for c in columns) for i in set(roots))

    cut = _written(spark, stages["suffix_dedup"](spark, alone, small), "cut")
    plain = [(r, (r.text or "").encode()) for r in alone.collect()]
    want = Counter()
    for (r, t), cover in zip(plain, covered_by_brute_force([t for _, t in plain], 200)):
        left = bytes(b for k, b in enumerate(t) if k not in cover).decode("utf-8", "ignore")
        want[r.doc_id, left, r.lang, r.source, len(left)] += 1
    assert cut.columns == list(columns) and tuples(cut) == want

    mixed = _written(spark, stages["mixing"](spark, cut, small), "mixed")
    copies = mixing.taken_copies(cut.select(*columns, shared.digest(*columns).alias("uid")), keep=("uid",)).select("own.keep0", "copies").collect()
    by_uid = {bytes(r.keep0): r.copies for r in copies}
    want = Counter({tuple(r[c] for c in columns): by_uid[bytes(r.uid)] for r in cut.select(*columns, shared.digest(*columns).alias("uid")).collect()})
    assert mixed.columns == list(columns) and tuples(mixed) == +want

    pieces = stages["packing"](spark, mixed, small).toPandas()
    assert Counter(pieces[pieces.start == 0].doc_id.fillna(-1)) == Counter(-1 if r.doc_id is None else r.doc_id for r in mixed.collect())


def test_near_copies_of_colliding_and_repeated_rows(spark, small):
    """Null ids, and rows alike in all columns: a document that is no copy stays, one of each group does."""
    words = lambda i: " ".join(f"w{i * 31 + k}" for k in range(40))
    rows = [(None, words(i), "en", "a", 1) for i in range(60)] + [(None, words(0), "en", "a", 1)] * 5 + [(3, words(1), "en", "b", 1)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, _written(spark, docs, "copies"), small).collect())
    assert got == Counter({(3 if i == 1 else None, words(i)): 1 for i in range(60)})


def test_pipeline_of_no_rows(spark, no_docs, small):
    docs = _written(spark, no_docs, "none")
    for name, stage in corpus_pipeline.STAGES:
        docs = _written(spark, stage(spark, docs, small), name)
        assert docs.count() == 0


def test_pipeline_runs(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_every_operator_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.QUERIES}) == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)
