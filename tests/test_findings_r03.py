"""Cases of round 3's findings."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import policies as po


def test_signed_weighs_bands_together(spark):
    """Bands that differ by less than the rounding of their products keep their entry, as in the SQL."""
    low = 0.1 + 0.2
    rows = spark.createDataFrame([("a", "b", 1, [low, 0.0, 0.3], 0.84), ("a", "c", 1, [0.3, 0.0, 0.3], 0.84)], "source string, target string, support long, bands array<double>, weight double")
    ends = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    got = {(r.source, r.target): r.adjacency for r in po.signed(rows.withColumn("source_bands", ends).withColumn("target_bands", ends)).collect()}
    assert got == {("a", "b"): 0.84 * (0.3 - low) / 2, ("b", "a"): 0.84 * (0.3 - low) / 2}


def test_mcnemar_of_very_many_pairs(spark):
    """0.5 to the power of all pairs underflows beyond 1,074 of them."""
    from loomtrace.operators import evaluation as ev

    def exact(w, l):  # noqa: E741
        return float(min(Fraction(1), Fraction(2 * sum(math.comb(w + l, i) for i in range(min(w, l) + 1)), 2 ** (w + l))))

    cases = [(332, 366), (700, 760), (5200, 5000), (0, 3), (4, 4)]
    got = [r[0] for r in spark.createDataFrame(cases, "w long, l long").select(ev.mcnemar(F.col("w"), F.col("l"))).collect()]
    assert all(abs(g - exact(*c)) < 1e-9 for g, c in zip(got, cases))


def test_digest_tree_of_bounded_depth(spark):
    """One level of buckets, whatever their size, as the SQL has it (F8)."""
    import hashlib

    from loomtrace.operators import snapshots as sn

    rows = [f'{{"a":"{i}"}}' for i in range(3000)]
    lines: dict[str, list[str]] = {}
    for d in sorted(hashlib.sha256(r.encode()).hexdigest() for r in rows):
        lines.setdefault(d[:2], []).append(f"{d}:1")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sha("\n".join(sha("\n".join(lines[k])) for k in sorted(lines)))
    got = sn.digest_tree(spark.range(3000).select(F.col("id").cast("string").alias("a")), leaf_rows=4, deepest=1).first()
    assert (got.digest, got.n) == (want, 3000)


@pytest.mark.parametrize("k", [1, 7, 500])
def test_ranking_where_rows_lie(spark, monkeypatch, k):
    """Rows are scored where they lie, and no more than the best of them are shuffled."""
    from loomtrace.operators import retrieval as rt
    from loomtrace.operators import textindex as ti

    from .test_textindex import texts

    monkeypatch.setattr(ti, "SLICE_ROWS", 16)
    rows = texts(300, seed=k)
    docs = spark.createDataFrame(rows + rows[:40] + [(None, "wa0 wb1 hopping"), (5, "wa0 ponies"), (6, "wa0 " + "filler " * 90_000)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "wa0 wb1 wc2"), (2, "wz25 pony ties WA0"), (3, "Größe cafe"), (4, "nothing-here"), (5, None), (6, "wf5 wa0")], "query_id long, query string")
    order = lambda df: sorted((r.query_id, r["rank"], r.doc is None, r.doc or 0, round(r.score, 6)) for r in df.collect())
    assert order(ti.ranked(docs, asked, k)) == order(ti.rank(ti.index_of(docs), asked, k))
    once = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    assert order(ti.ranked(once, asked, k, stems=False)) == order(rt.bm25(once, asked, k))
    assert order(ti.ranked(docs, asked, k, stems=False)) == order(rt.bm25(docs, asked, k))


def test_search_holds_few_products_at_once(spark, monkeypatch):
    """Products are made for some queries at a time; copies at the k-th place go by id."""
    import numpy as np

    from loomtrace.operators import retrieval as rt

    monkeypatch.setattr(rt, "CELLS", 100)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 6))
    v[30:50], v[7] = v[3], 0.0  # copies, and a vector without direction
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "skill_id long, vector array<double>")
    got = rt.search(rows.select(F.col("skill_id").alias("query_id"), "vector"), rows, 5)
    n = np.linalg.norm(v, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.round(np.where(np.outer(n, n) > 0, v @ v.T / np.outer(n, n), -np.inf), 12)
    want = {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(-c[i], kind="stable")[:5])}
    assert {(r.query_id, r["rank"]): r.skill_id for r in got.collect()} == want
    assert rt.matrix_of(__import__("pyarrow").chunked_array([[[1.0, 2.0]], [[3.0, 4.0]]])).tolist() == [[1.0, 2.0], [3.0, 4.0]]


@pytest.mark.parametrize("run", [4, 64])
def test_search_excludes_in_single_precision(spark, monkeypatch, run):
    """What single precision cannot tell apart is told by the exact cosine, and the index is dealt to several tasks."""
    import numpy as np

    from loomtrace.operators import retrieval as rt

    for name, value in (("RUN", run), ("CELLS", 3000), ("LEAST_BYTES", 1 << 10)):
        monkeypatch.setattr(rt, name, value)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((900, 6)) * np.exp(rng.standard_normal((900, 1)) * 20)
    v[200:500] = v[3] + 1e-9 * np.abs(v[3]) * rng.standard_normal((300, 6))  # nearer to each other than single precision
    v[600:640], v[7], v[650:660] = v[5], 0.0, 0.0
    penalty = np.where(np.arange(900) % 7 == 0, 0.05, 0.0)
    rows = spark.createDataFrame([(i, x.tolist(), float(p)) for i, (x, p) in enumerate(zip(v, penalty))], "skill_id long, vector array<double>, penalty double")
    found = rt.search(rows.select(F.col("skill_id").alias("query_id"), "vector"), rows.drop("penalty"), 5, penalties=rows.select("skill_id", "penalty"))
    n = np.linalg.norm(v, axis=1)
    c = np.divide(v @ v.T, np.outer(n, n), out=np.full((900, 900), -np.inf), where=np.outer(n, n) > 0)
    got = {(r.query_id, r["rank"]): (r.skill_id, r.score) for r in found.collect()}
    score = np.round(c - penalty, 12)
    for i in range(900):
        best = np.lexsort((np.arange(900), -np.round(c[i], 12), -score[i]))[:5]
        assert [got[i, r][1] for r in range(1, 6)] == pytest.approx(score[i][best].tolist(), abs=2e-12)
        if not (i == 3 or 200 <= i < 500):  # there the last digits of a product decide
            assert [got[i, r][0] for r in range(1, 6)] == best.tolist()
    assert found.count() == 4500
    assert len({tuple(sorted(x)) for x in [near.tolist() for near in rt._near(v, v, penalty, 5)]}) > 1
    assert sum(len(near) for near in rt._near(v, v, penalty, 5)) < 900 * 450  # most rows are excluded


def test_draws_are_not_broadcast(spark, monkeypatch):
    """Draws grow with tasks and samples, whatever they are made from."""
    from loomtrace.operators import deployment as dp

    seen = []
    real = dp.first_front
    monkeypatch.setattr(dp, "first_front", lambda items, *more: seen.append(items) or real(items, *more))
    pairs = spark.range(40).selectExpr("id AS sample_id", "0 AS repeat_id", "concat('high_', id % 3) AS bundle", "id % 2 = 0 AS base_success", "id % 3 = 0 AS cand_success", "3 AS base_steps", "2 AS cand_steps")
    dp.bootstrap_pareto(pairs, samples=5, seed=7)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "MapInPandas" in plan.split("SortMergeJoin", 1)[1]


def test_products_of_a_held_matrix(spark):
    """The pairs are those that a job a product gives, without its jobs."""
    import numpy as np

    from loomtrace.operators import graphs as gr

    rng = np.random.default_rng(3)
    cells = {(int(i), int(j)) for i, j in rng.integers(0, 40, (160, 2)) if i < j}
    rows = [(2 * a, 2 * b, -0.1 * (1 + (i * j) % 3)) for i, j in sorted(cells) for a, b in ((i, j), (j, i))]
    entries = spark.createDataFrame(rows, "i long, j long, value double")
    ids = np.array(sorted({r[0] for r in rows} | {1000}))
    dense = np.linalg.eigvalsh(gr._dense(entries, ids))[:3]
    jobs = []
    for held in (gr.HELD_ENTRIES, 0):
        spark.sparkContext.setJobGroup(f"held{held}", "")
        _, values, vectors = gr._lanczos(entries, ids, 3, 1, held)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"held{held}")))
        assert np.allclose(values, dense, atol=1e-9)
    assert jobs[0] < jobs[1]


def test_neighbours_by_blocks(spark, monkeypatch):
    """Several blocks from ``SPREAD_NODES`` on, and copies at the k-th place in the order of their ids."""
    import numpy as np

    from loomtrace.operators import graphs as gr

    monkeypatch.setattr(gr, "SPREAD_NODES", 50)
    v = np.random.default_rng(5).standard_normal((330, 5))
    v[100:160], v[8] = v[4], 0.0
    nodes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "segment_id long, embedding array<double>")
    u = np.divide(v, np.linalg.norm(v, axis=1)[:, None], out=np.zeros_like(v), where=np.linalg.norm(v, axis=1)[:, None] > 0)
    d = (u**2).sum(axis=1)[:, None] + (u**2).sum(axis=1)[None, :] - 2 * u @ u.T
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1): int(j) for i in range(330) for k, j in enumerate(np.argsort(np.round(d[i], 12), kind="stable")[:7])}
    near = gr.neighbours(nodes, 7)
    assert {(r.source, r["rank"]): r.target for r in near.collect()} == want
    assert gr.neighbours(nodes.limit(1), 7).count() == 0


def test_similarity_has_weak_pairs(spark, small):
    """Pairs below a cosine of 0.8 belong to the job."""
    import __spark_entry__ as entry

    values = [r.value for r in entry.queries()["g14_sequence_similarity"](spark, small).collect()]
    assert min(values) < 0.8 < max(values)


def test_links_are_counted_without_pairs(spark, monkeypatch):
    """No row a pair is made for the number of links (F2)."""
    import numpy as np

    from loomtrace.operators import mining as mi

    for name, n in (("COUNTED_ROWS", 20), ("SLICE_ROWS", 7)):
        monkeypatch.setattr(mi, name, n)
    rng = np.random.default_rng(2)
    rows = [(f"t{t}", f"f{f}", float(1 + (t * f) % 3)) for t in range(120) for f in set(rng.integers(0, 8, 4).tolist())]
    membership, classes = mi.sequence_classes(spark.createDataFrame(rows, "trajectory_id string, feature string, weight double"))
    got = mi.links(membership, classes, 0.8)
    assert sorted(got.collect()) == sorted(mi.linked(membership, classes, mi.similar_classes(classes, 0.8)).collect())


@pytest.mark.parametrize("least, whole", [(1e-12, True), (0.95, False)])
def test_weak_pairs_are_multiplied_once(spark, monkeypatch, least, whole):
    """A threshold that excludes nothing needs no index, which has a pair in a block of each common feature; equal sequences are one before they are weighed."""
    import numpy as np

    from loomtrace.operators import mining as mi

    for name, n in (("PAIR_ROWS", 20), ("SLICE_ROWS", 7)):
        monkeypatch.setattr(mi, name, n)
    rng = np.random.default_rng(6)
    runs = [[str(e) for e in rng.integers(0, 7, rng.integers(1, 6))] for _ in range(110)]
    rows = [(f"t{i}", [e for n, e in enumerate(r) if not n or e != r[n - 1]]) for i, r in enumerate(runs + runs[:60] + runs[:30])]
    sequences = spark.createDataFrame(rows, "trajectory_id string, seq array<string>").persist()
    weights = mi.sequence_weights(sequences)
    once = mi.sequence_weights(mi.distinct_sequences(sequences))
    assert once.count() < weights.count()
    classes = mi.sequence_classes(once)[1]
    order = lambda df: sorted((r.class_id, r.members, len(r.x), round(sum(r.x), 9)) for r in df.collect())
    assert order(classes) == order(mi.sequence_classes(weights)[1])
    labels = []
    real = mi.staged
    monkeypatch.setattr(mi, "staged", lambda df, label: labels.append(label) or real(df, label))
    got = mi.similar_classes(classes, least).collect()
    assert ("indexed" in labels) != whole
    vectors = {r.class_id: dict(zip(r.f, r.x)) for r in classes.collect()}
    cosine = {(i, j): sum(x * vectors[j].get(f, 0.0) for f, x in vectors[i].items()) for i in vectors for j in vectors if i < j}
    assert len(got) == len({(r.i, r.j) for r in got})
    assert {(r.i, r.j): round(r.value, 9) for r in got} == {p: round(c, 9) for p, c in cosine.items() if c >= least}


@pytest.mark.parametrize("there", [True, False])
def test_episode_files(spark, tmp_path, monkeypatch, there):
    """One file an episode, written by the tasks where the folder is mounted; a repeated id raises."""
    import hashlib
    import json

    from loomtrace.sources import files as fs

    if not there:
        monkeypatch.setattr(fs, "mounted", lambda *_: None)
    rows = spark.range(70).selectExpr("concat('u/', id, ' ü') AS trajectory_id", "id AS sample_id", "'a\"b' AS method", "1 AS repeat_id", "CASE WHEN id > 3 THEN 0.5D END AS primary_score", "array(named_struct('step_index', 0, 'event_type', 'view', 'k', 2, 'reward', 1.5D)) AS steps").repartition(3)
    fs.write_episode_files(rows, str(tmp_path / "e"))
    back = fs.read_episode_files(spark, str(tmp_path / "e"))
    assert sorted(map(repr, back.drop("file").collect())) == sorted(map(repr, rows.collect()))
    assert back.select("file").distinct().count() == 70
    if there:
        found = sorted(p for p in (tmp_path / "e").rglob("*") if p.is_file())
        assert [p.name for p in found] == [hashlib.sha256(json.loads(p.read_text())["trajectory_id"].encode()).hexdigest() + ".json" for p in found]
    with pytest.raises(Exception, match="duplicate trajectory_id"):
        fs.write_episode_files(rows.unionByName(rows.limit(1)), str(tmp_path / "twice"))
    fs.write_episode_files(rows.limit(0), str(tmp_path / "none"))
    assert fs.read_episode_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(("query", "k"), [("r05_steps_by_name", 5), ("r07_provider_flow", 3), ("r03_diverse_candidates", 20), ("r01_cosine_search", 5)])
def test_search_queries_take_bounded_memory(spark, small, monkeypatch, query, k):
    """A task of the query's search holds few products, however many rows its block has."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import GroupedData

    import __spark_entry__ as entry

    steps = []
    real = GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: steps.append(f) or real(self, f, schema))
    entry.queries()[query](spark, small)
    rng = np.random.default_rng(12)
    a, b = rng.standard_normal((600, 4)), rng.standard_normal((30_000, 4))
    b[100:20_000:7] = b[5]  # a large group of copies
    penalty = np.where(np.arange(len(b)) % 7 == 0, 0.05, 0.0)
    ids, none = pa.array(range(len(b))), lambda n: pa.nulls(n, pa.int64())
    rows = pa.table({"q": pa.concat_arrays([pa.array(range(len(a))), none(len(b))]), "s": pa.concat_arrays([none(len(a)), ids]), "v": pa.array([*a.tolist(), *b.tolist()]), "penalty": np.concatenate([np.zeros(len(a)), penalty])})
    tracemalloc.start()
    try:
        found = steps[0](rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(steps) == 1 and peak < 48 << 20  # all products take 144 MB
    got = np.asarray(found.column("s")).reshape(len(a), k)
    for i in range(0, len(a), 50):
        c = b @ a[i] / (np.linalg.norm(b, axis=1) * np.linalg.norm(a[i]))
        assert got[i].tolist() == np.lexsort((-np.round(c, 12), -np.round(c - penalty, 12)))[:k].tolist()
