"""Operators on hand-made rows whose results are known."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.functions import text as tx
from loomtrace.functions import vectors as vx
from loomtrace.operators import deployment as dp
from loomtrace.operators import evaluation as ev
from loomtrace.operators import graphs as gr
from loomtrace.operators import labels as lb
from loomtrace.operators import manifests as mf
from loomtrace.operators import mining as mi
from loomtrace.operators import policies as po
from loomtrace.operators import retrieval as rt
from loomtrace.operators import runs as rn
from loomtrace.operators import segmentation as sg
from loomtrace.operators import sequences as sq
from loomtrace.operators import validation as va
from loomtrace.plans import selectors
from loomtrace.sources import files as fs


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("command, want", [("go to shelf 1", "goto"), ("take a from b", "pick"), ("pick a", "pick"), ("MOVE a to b", "put"), (" inventory ", "inventory"), ("look", "look"), ("use lamp", "toggle"), ("go to ", "invalid"), ("goto x", "invalid"), ("slice it", "slice")])
def test_household_actions(spark, command, want):
    assert one(spark, lb.household_action(F.lit("take_action"), F.col("c")), c=command) == want


@pytest.mark.parametrize("command, want", [("take mug 1 from shelf 2", "PICK_UP(mug, shelf)"), ("move mug 3 to drawer 1", "PUT(mug, drawer)"), ("heat egg 1 with microwave 1", "HEAT(egg, microwave)"), ("go to shelf 12", "GO_TO(shelf)"), ("Look", "LOOK"), ("juggle 3 balls 4", "JUGGLE BALLS")])
def test_action_signatures(spark, command, want):
    assert one(spark, tx.action_signature(F.col("c")), c=command) == want


@pytest.mark.parametrize("text, want", [("WebShop search page.\nx", "search"), ("Search results page 2", "results"), ("PRODUCT: x", "item"), ("Reviews: none", "item_detail"), ("Purchase completed", "terminal"), ("", "unknown")])
def test_page_types(spark, text, want):
    assert one(spark, lb.page_type(F.col("t")), t=text) == want


def test_goal_events_are_substrings(spark):
    assert one(spark, lb.goal_events(F.col("g")), g="Find a flight and cut bread") == ["slice_object", "toggle_object"]


def test_scalar_text_functions(spark):
    assert one(spark, tx.normalise(F.col("t")), t="  A\t b\n C ") == "a b c"
    for t in ("Straße ΣΑΣ ς ﬁn", "İstanbul ĲSSEL", "ŉ ǰ Ⅷ K", "Ꭰ ꭰ", "PLAIN", ""):
        assert one(spark, tx.folded(F.col("t")), t=t) == t.casefold()
    assert one(spark, tx.phrase_visible(F.col("p"), F.col("t")), p="Red shoe", t="a shoe, RED!") is True
    assert one(spark, tx.phrase_visible(F.col("p"), F.col("t")), p="--", t="x") is False
    assert one(spark, tx.prices(F.col("t")), t="Price: 3.5 | $12 and | $7.25") == [3.5, 12.0, 7.25]
    assert one(spark, tx.selected_count(F.col("t")), t="Selected: {a: 1; b: 2} {c: 3}") == 2
    assert one(spark, lb.price_signal(F.col("t"), F.lit(None).cast("double")), t="Price: 3") == "unknown"


def test_cosine_conventions(spark):
    zero, x = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert spark.range(1).select(vx.cosine(zero, x, -1.0)).first()[0] == -1.0
    assert spark.range(1).select(vx.unit(zero)).first()[0] == [0.0, 0.0]
    assert spark.range(1).select(vx.unit(x)).first()[0] == [0.6, 0.8]


STEPS = "trajectory_id string, step_index int, event_type string"


def test_segments_sequences_and_ngrams(spark):
    s = spark.createDataFrame([("t", i, e) for i, e in enumerate("aabbca")][::-1] + [("u", 0, "a")], STEPS)
    segs = sq.segments(s)
    assert sorted((r.start_step, r.end_step, r.event_type) for r in segs.where("trajectory_id = 't'").collect()) == [(0, 1, "a"), (2, 3, "b"), (4, 4, "c"), (5, 5, "a")]
    seqs = {r.trajectory_id: r.seq for r in sq.sequences(segs).collect()}
    assert seqs == {"t": ["a", "b", "c", "a"], "u": ["a"]}
    grams = sq.sequences(segs).select(F.explode(sq.ngrams(F.col("seq"), 3)).alias("g")).collect()
    assert sorted("".join(r.g) for r in grams) == ["ab", "abc", "bc", "bca", "ca"]
    assert spark.range(1).select(sq.anchor(F.array(*map(F.lit, "abab")), F.array(F.lit("b"), F.lit("a")))).first()[0] == 1
    assert spark.range(1).select(sq.anchor(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a")))).first()[0] is None


def test_null_labels_form_runs_of_their_own(spark):
    s = spark.createDataFrame([("t", 0, None), ("t", 1, None), ("t", 2, "a")], STEPS)
    assert sorted(r.n_steps for r in sq.segments(s).collect()) == [1, 2]


def test_23_rows_over_10_shards(spark):
    m = spark.range(23).withColumnRenamed("id", "sample_id")
    assert [r["count"] for r in sq.shards(m, 10, "sample_id").groupBy("shard").count().orderBy("shard").collect()] == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]
    with pytest.raises(ValueError):
        mf.expand(m, (0, 0))


def nodes(spark, rows):
    return spark.createDataFrame(rows, "segment_id long, trajectory_id long, start_step int, event_type int, outcome double, embedding array<double>")


def test_opposite_outcomes_of_equal_vectors_meet_in_the_middle(spark):
    n = nodes(spark, [(1, 1, 0, 0, 1.0, [1.0, 0.0]), (2, 2, 0, 0, 0.0, [1.0, 0.0])])
    assert [r.rho for r in gr.smoothed_outcome(n, gr.neighbours(n)).collect()] == [0.5, 0.5]


def test_collapse_takes_the_mean_and_ignores_the_sign_of_zero(spark):
    n = nodes(spark, [(1, 1, 0, 0, 1.0, [1.0, 0.0]), (2, 2, 0, 0, 1.0, [1.0, -0.0]), (3, 3, 0, 0, 0.0, [1.0, 0.0]), (4, 4, 0, 1, 0.0, [1.0, 0.0])])
    got = {r.node_id: (r.members, r.outcome) for r in gr.collapsed(n).collect()}
    assert got[1][0] == [1, 2, 3] and abs(got[1][1] - 2 / 3) < 1e-12 and got[4] == ([4], 0.0)


def test_neighbours_equal_brute_force_in_one_and_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((257, 8))
    n = nodes(spark, [(i, i, 0, 0, 0.0, [float(v) for v in x[i]]) for i in range(257)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -9)
    want = {(i, int(j)) for i in range(257) for j in np.argsort(-c[i])[:10]}
    for block in (20_000, 100):
        monkeypatch.setattr(gr, "BLOCK_NODES", block)
        assert {(r.source, r.target) for r in gr.neighbours(n, 10).collect()} == want


def test_a_single_zero_vector(spark):
    n = nodes(spark, [(1, 1, 0, 0, 1.0, [0.0, 0.0])])
    near = gr.neighbours(n)
    assert near.count() == 0 and gr.smoothed_outcome(n, near).first().rho == 1.0
    assert gr.laplacian(gr.edge_algebra(n, near, gr.smoothed_outcome(n, near))).count() == 0


def test_transition_denominator_counts_self_pairs(spark):
    n = nodes(spark, [(1, 1, 0, 0, 1.0, [1.0]), (2, 1, 1, 0, 1.0, [2.0]), (3, 1, 2, 1, 1.0, [3.0])])
    assert {(r.i, r.j): r.transition for r in gr.transition_values(gr.observed(n)).collect()} == {(1, 2): 0.5, (2, 3): 0.5}


def two_blocks(spark):
    e = [(i, j, 1.0 if (i < 4) == (j < 4) else 0.02) for i in range(8) for j in range(i + 1, 8)]
    return spark.createDataFrame(e, "i long, j long, adjacency double")


def test_eigenpairs_and_partition_of_two_blocks(spark):
    lap = gr.laplacian(two_blocks(spark))
    ids = np.array(sorted({r.i for r in lap.select("i").collect()}))
    m = gr._dense(lap, ids)
    for dense in (4000, 1):
        _, values, vectors = gr.eigenpairs(lap, 4, dense_nodes=dense)
        assert np.abs(m @ vectors - vectors * values).max() < 1e-8
        k, rows = gr.eigengap(values, vectors, 1, 1)  # the constant vector is dropped; the next one tells the blocks apart
        labels = gr.k_means(rows, 2)
        assert labels[:4].tolist() == [0] * 4 and labels[4:].tolist() == [1] * 4


def test_modularity_finds_two_groups():
    a = np.kron(np.eye(2), np.ones((4, 4)) - np.eye(4))
    groups, q = gr.modularity_groups(a)
    assert groups == [[0, 1, 2, 3], [4, 5, 6, 7]] and abs(q - 0.5) < 1e-12
    assert gr.modularity_groups(np.zeros((3, 3))) == ([[0, 1, 2]], 0.0)


def test_component_labels(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "i long, j long")
    assert {r.node: r.label for r in gr.component_labels(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_contrastive_paths(spark):
    s = spark.createDataFrame([("t1", ["a", "b", "c"]), ("t2", ["a", "b", "c"]), ("t3", ["c", "a", "b"])], "trajectory_id string, seq array<string>")
    o = spark.createDataFrame([("t1", 1, True), ("t2", 2, True), ("t3", 3, False)], "trajectory_id string, sample_id long, positive boolean")
    got = {"".join(r.path): r for r in mi.mine_paths(s, o).collect()}
    assert set(got) == {"bc", "abc"}  # ab is in all of both classes: score 0
    assert abs(got["bc"].score - math.log((1 + 1e-6) / 1e-6)) < 1e-9
    assert mi.mine_or_best(s, o, least_count=99).count() == 1


def test_change_points(spark):
    t = spark.createDataFrame([("a", i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)] + [("b", i, [1.0, 1.0]) for i in range(7)] + [("c", 0, [0.0, 0.0])], "trajectory_id string, step_index int, embedding array<double>")
    got = {}
    for r in sg.change_points(t, penalty=1.0).collect():
        got.setdefault(r.trajectory_id, []).append((r.start_step, r.end_step))
    assert {k: sorted(v) for k, v in got.items()} == {"a": [(0, 2), (3, 5)], "b": [(0, 5), (6, 6)], "c": [(0, 0)]}
    penalty, median = sg.calibrate(t.where("trajectory_id = 'a'"), target=3)
    assert median == 3.0 and penalty >= 0


EPISODES = "sample_id long, method string, repeat_id int, success boolean, steps int, primary_score double, invalid_actions int, billable_tokens long"


def test_pooled_rate_usage_and_task_means(spark):
    e = spark.createDataFrame([(0, "m", 0, True, 2, 1.0, 1, None), (0, "m", 1, True, 8, 1.0, 1, 4), (1, "m", 0, False, 5, 0.0, 0, None)], EPISODES)
    r = ev.method_summary(e).first()
    assert r.invalid_rate == 2 / 15 and r.billable_tokens_sum == 4 and r.billable_tokens_mean == 4.0 and abs(r.billable_tokens_coverage - 1 / 3) < 1e-12
    assert ev.task_means(e, F.col("primary_score")).first().task_mean == 0.5  # not the pooled two thirds
    assert ev.unpaired(e, "m", "n").count() == 3


def test_guarded_saving(spark):
    p = spark.createDataFrame([(True, False, 10, 5), (False, True, 10, 5), (True, True, 0, 3)], "base_success boolean, cand_success boolean, base_steps int, cand_steps int")
    assert [r[0] for r in p.select(ev.guarded_saving()).collect()] == [0.0, 0.5, -3.0]


def test_mcnemar_and_pearson(spark):
    p = spark.createDataFrame([(43, 5), (16, 7), (0, 0)], "w int, l int").select(ev.mcnemar(F.col("w"), F.col("l"))).collect()
    assert abs(p[0][0] - 1.368e-8) < 1e-11 and abs(p[1][0] - 0.0931) < 1e-4 and p[2][0] == 1.0
    assert spark.range(3).select(F.lit(1.0).alias("a"), F.col("id").alias("b")).agg(ev.pearson("a", "b")).first()[0] is None


def test_bootstrap_draws_equal_numpy(spark):
    t = spark.createDataFrame([(i, float(i * i % 7)) for i in range(20)], "sample_id long, value double")
    v = np.array([float(i * i % 7) for i in range(20)])
    rng = np.random.default_rng(42)
    want = np.concatenate([v[rng.integers(0, 20, size=(n, 20))].mean(axis=1) for n in (512, 88)])
    got = np.array([r["mean"] for r in ev.bootstrap_means(t, samples=600, seed=42).orderBy("b").collect()])
    assert np.array_equal(got, want)
    i = ev.interval(ev.bootstrap_means(t, samples=600, seed=42)).first()
    assert abs(i.ci_low - np.quantile(want, 0.025)) < 1e-12 and i.ci_low <= v.mean() <= i.ci_high


def test_pareto_ranks(spark):
    t = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0), ("c", 0.0, 0.0)], "item_id string, x double, y double")
    assert {r.item_id: r.front for r in dp.fronts(t, ("x", "y")).collect()} == {"a": 1, "b": 1, "c": 2}


def test_lineage_kinds(spark):
    old = spark.createDataFrame([(i, i // 4) for i in range(12)], "segment_id long, old_id long")
    new = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 2), (50, 9)], "segment_id long, new_id long")
    assert sorted((r.kind, r.old_ids, r.new_ids) for r in dp.lineage(old, new).collect()) == [("continuation", [1], [2]), ("disappeared", [2], []), ("new", [], [9]), ("split", [0], [0, 1])]


def test_similarity_boundary_is_whole_percent(spark):
    row = ("e", "one", "one", True, "s", "unknown", False)
    n = spark.createDataFrame([("n1", *row), ("n2", *row[:4], "other", *row[5:])], "node_id string, event_type string, attribute_count string, option_count string, requires_price_check boolean, signal string, price_signal string, repeated_event boolean")
    assert sorted((r.source, r.percent) for r in po.similar(n).collect()) == [("n1", 75), ("n2", 75)]


def test_backbone_ties(spark):
    links = spark.createDataFrame([("q", "a", 3), ("q", "b", 3), ("a", "p", 3), ("b", "p", 3), ("a", "b", 9)], "source string, target string, support long")
    r = po.backbone(links, ("q",), "p").first()
    assert (r.path, r.weakest) == ("q>a>b>p", 3)  # a greater product of links wins among equal weakest links


def test_search_penalties_and_diversity(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    x = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.001]), ("c", [0.7, 0.7]), ("z", [0.0, 0.0])], "skill_id string, vector array<double>")
    pen = spark.createDataFrame([("a", 0.5)], "skill_id string, penalty double")
    found = rt.search(q, x, 4, penalties=pen)
    assert [r.skill_id for r in found.orderBy("rank").collect()] == ["b", "c", "a", "z"]
    assert abs(found.where("skill_id = 'a'").first().cosine - 1.0) < 1e-12
    got = rt.diverse(rt.search(q, x, 4), x, least=0.0, margin=2.0, same=0.99, relevance=0.5, most=3)
    assert [r.skill_id for r in got.orderBy("place").collect()] == ["a", "c"]


def test_cache_and_reuse(spark):
    c = spark.createDataFrame([("m", "h1", [1.0])], "model string, content_hash string, vector array<double>")
    new = spark.createDataFrame([("m", "h1", [9.0]), ("m", "h2", [2.0]), ("m", "h2", [3.0])], c.schema)
    assert {r.content_hash: r.vector for r in fs.upsert(c, new).collect()} == {"h1": [1.0], "h2": [2.0]}


def test_constraints(spark):
    s = spark.createDataFrame([("t", 0), ("t", 2), ("u", 0)], "trajectory_id string, step_index int")
    assert [r.trajectory_id for r in va.gaps(s).collect()] == ["t"]
    with pytest.raises(ValueError):
        va.require_empty(va.duplicates(s, "trajectory_id"), "twice")
    assert va.missing_from_grid(spark.createDataFrame([(1, 0)], "sample_id long, repeat_id int"), spark.createDataFrame([(1,)], "sample_id long"), (0, 1)).first().repeat_id == 1


def test_selectors():
    assert selectors.shard_ids("0,2-4", 10) == [0, 2, 3, 4]
    for bad in ("0,0", "11"):
        with pytest.raises(ValueError):
            selectors.shard_ids(bad, 10)
    with pytest.raises(ValueError):
        selectors.assignments(["a=/x", "a=/y"])


def test_jsonl_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"trajectory_id": "t", "sample_id": 1}\n\n{"trajectory_id": "t", "sample_id": 2}\n')
    with pytest.raises(ValueError):
        fs.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    with pytest.raises(ValueError):
        fs.goal_range(spark, 5, 3, 10, (0,))


def test_partitions_repeat_and_are_disjoint(spark):
    ids = spark.range(40).withColumnRenamed("id", "sample_id")
    a, b = (sorted((r.sample_id, r.part) for r in mf.partition(ids, {"x": 10, "y": 5}, seed=3).collect()) for _ in range(2))
    assert a == b and len(a) == 15 == len({i for i, _ in a})
    s = mf.selections(ids, seeds=(1, 2), size=6).collect()
    assert len({r.sample_id for r in s}) == 12


def _unit_rows(rng, n, kinds):
    x = rng.random((n, kinds)) * (rng.random((n, kinds)) < 0.4)
    x[np.arange(n), np.arange(n) % 3] += 2.0
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    at, feature = np.nonzero(u)
    return gr.FeatureGraph(at, feature, u[at, feature], u.shape)


def test_modularity_of_rows_is_that_of_their_pairs():
    g = _unit_rows(np.random.default_rng(5), 120, 9)
    want, q = gr.modularity_groups(g.dense())
    found, p = gr.modularity_groups(g, dense_nodes=10)
    assert found == want and len(want) > 1 and p == pytest.approx(q, abs=1e-12)


def test_communities_hold_every_success(spark, tmp_path):
    """450 successful trajectories: more than the 400 once taken."""
    from loomtrace.queries import graphing as gq

    kinds = ["purchase", "view", "click", "signup"]
    rows = [(u * 4 + k, u, kinds[0 if k == 3 else (u // 3**k + k) % 4], 1.0, '{"k": 5}') for u in range(450) for k in range(4)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    e.selectExpr("event_id", "timestamp'2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    sizes = [r["size"] for r in gq.g15(spark, str(tmp_path)).collect()]
    members = [t for r in gq.g16(spark, str(tmp_path)).collect() for t in r["trajectories"].split(",")]
    assert sum(sizes) == 450 and len(set(members)) == len(members) == 450


def test_communities_beyond_the_dense_limit(spark):
    """Over 4000 trajectories are split too; once they raised."""
    s = spark.range(4100).selectExpr("concat('t', id) AS trajectory_id", "CASE WHEN id % 2 = 0 THEN array('a', 'b', 'a') ELSE array('c', 'd', if(id % 4 = 1, 'c', 'e')) END AS seq")
    paths = spark.createDataFrame([], "path_id string, trajectories array<string>")
    found, q = mi.communities(s, paths)
    assert sum(len(r["trajectories"]) for r in found.collect()) == 4100 and q > 0.4


def test_ranking_covers_every_benchmark_query(spark, small):
    import duckdb

    from loomtrace.queries import graphing as gq

    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    want = c.execute(f"WITH {gq._BM_ALL} SELECT query_id, rank, doc, score FROM k WHERE rank <= 10 ORDER BY 1, 2").fetchall()
    got = sorted((r["query_id"], r["rank"], r["doc"], r["score"]) for r in gq.r08_all(spark, small).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1.1e-4)
    items = {r[0] for r in c.execute("SELECT item_id FROM benchmark").fetchall()}
    assert max(items) >= 10 and {r[0] for r in got} == items == {r["query_id"] for r in gq.t03_all(spark, small).select("query_id").collect()}


def _cosines(weights):
    rows = {}
    for t, f, w in weights:
        if w:
            rows.setdefault(t, {})[f] = w
    norm = {t: math.sqrt(sum(w * w for w in x.values())) for t, x in rows.items()}
    return rows, {(i, j): sum(w * y.get(f, 0.0) for f, w in x.items()) / norm[i] / norm[j] for i, x in rows.items() for j, y in rows.items() if i != j}


@pytest.mark.parametrize("least, block", [(0.8, 1024), (0.3, 16), (1e-12, 7)])
def test_similar_classes_lose_no_link(spark, monkeypatch, least, block):
    monkeypatch.setattr(mi, "PAIR_ROWS", block)
    rng = random.Random(block)
    seqs = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))] for _ in range(90)]
    seqs += seqs[:30] + [["a", "b"]] * 40  # copies, and a third of the rows alike
    s = spark.createDataFrame([(f"t{k:03}", q) for k, q in enumerate(seqs)], "trajectory_id string, seq array<string>")
    weights = mi.sequence_weights(s)
    rows, cosine = _cosines(weights.collect())
    membership, classes = mi.sequence_classes(weights)
    pairs = mi.similar_classes(classes, least)
    of = {r.trajectory_id: r.class_id for r in membership.collect()}
    assert set(of) == set(rows) and all(rows[t] == rows[c] and c <= t for t, c in of.items()) and len(set(of.values())) == len({tuple(sorted(x.items())) for x in rows.values()})
    got = {(r.i, r.j): r.value for r in pairs.collect()}
    want = {(i, j): v for (i, j), v in cosine.items() if i < j and of[i] == i and of[j] == j and v >= least}
    assert pairs.count() == len(got) and got.keys() == want.keys() and got
    assert all(got[p] == pytest.approx(want[p]) for p in got)
    links = {r.trajectory_id: r.links for r in mi.linked(membership, classes, pairs).collect()}
    assert links == {t: sum((of[t] == of[o] or cosine[t, o] >= least) for o in of if o != t) for t in of}
    strong = {r.trajectory_id: r.strength for r in mi.strengths(weights).collect()}
    assert strong == pytest.approx({t: sum(v for (i, _), v in cosine.items() if i == t) for t in of})


def test_no_sequences_have_no_pairs(spark):
    none = spark.createDataFrame([], "trajectory_id string, feature string, weight double")
    membership, classes = mi.sequence_classes(none)
    assert membership.count() == classes.count() == mi.similar_classes(classes, 0.5).count() == mi.strengths(none).count() == 0
    with pytest.raises(ValueError):
        mi.similar_classes(classes, 0.0)


def _calibrated(sequences, target, longest, rounds=40):
    from statistics import median

    costs = [sg.segment_costs(x, longest) for x in sequences]
    at = lambda p: float(median(e - s + 1 for c in costs for s, e in sg.boundaries(c, p)))
    low, high, tried = 0.0, 1.0, {0.0: at(0.0)}
    for _ in range(40):
        tried[high] = at(high)
        if tried[high] >= target:
            break
        high *= 2
    else:
        rounds = 0
    for _ in range(rounds):
        mid = (low + high) / 2
        tried[mid] = at(mid)
        low, high = (mid, high) if tried[mid] < target else (low, mid)
    best = min(tried, key=lambda p: (abs(tried[p] - target), p))
    return best, tried[best]


@pytest.mark.parametrize("target, longest", [(2, 6), (3, 6), (4, 4)])
def test_calibrated_penalty_is_that_of_plain_bisection(spark, target, longest):
    rng = np.random.default_rng(3)
    sequences = [rng.standard_normal((12, 4)) for _ in range(6)]
    rows = spark.createDataFrame([(i, k, v.tolist()) for i, x in enumerate(sequences) for k, v in enumerate(x)], "trajectory_id long, step_index int, embedding array<double>")
    assert sg.calibrate(rows, target=target, longest=longest) == _calibrated(sequences, target, longest)


def _signed_laplacian(a):
    d = np.abs(a).sum(axis=1)
    return np.eye(len(a)) - a / np.sqrt(np.outer(d, d))


def _neighbour_graph(rng, n):
    x = rng.standard_normal((n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    a = np.zeros((n, n))
    for i in range(n):
        a[i, np.argsort(-c[i])[1:7]] = 1
    return np.maximum(a, a.T) * np.maximum(c, 0.01)


@pytest.mark.parametrize("copies, n", [(1, 400), (3, 60)])
def test_eigenpairs_beyond_the_dense_limit_are_exact(spark, copies, n):
    """Hundreds of nodes, and equal components whose eigenvalues come three times: 60 steps with one vector do not get them."""
    m = np.kron(np.eye(copies), _signed_laplacian(_neighbour_graph(np.random.default_rng(8), n)))
    i, j = np.nonzero(m - np.diag(np.diag(m)))
    rows = spark.createDataFrame([(int(x), int(y), float(m[x, y])) for x, y in zip(i, j)], "i long, j long, value double")
    _, values, vectors = gr.eigenpairs(rows, 16, dense_nodes=20)
    assert values == pytest.approx(np.linalg.eigvalsh(m)[:16], abs=1e-9)
    assert np.linalg.norm(m @ vectors - vectors * values, axis=0).max() < 1e-8


def test_component_of_a_long_path(spark):
    """A path of 300 nodes in steps of one: a hundred rounds were not enough."""
    e = spark.range(299).selectExpr("id AS i", "id + 1 AS j")
    assert {r.label for r in gr.component_labels(e).collect()} == {0}


def test_nodes_without_edges_keep_their_diagonal(spark):
    lap = gr.laplacian(two_blocks(spark))
    nodes = lap.select("i").distinct().unionByName(spark.createDataFrame([(98,), (99,)], "i long"))
    for dense in (100, 4):
        ids, values, vectors = gr.eigenpairs(lap, len(nodes.collect()), nodes=nodes, dense_nodes=dense)
        assert {98, 99} < set(ids.tolist())
        m = np.eye(len(ids))
        for r in lap.collect():
            m[list(ids).index(r.i), list(ids).index(r.j)] = r.value
        assert values == pytest.approx(np.linalg.eigvalsh(m)[: len(values)], abs=1e-8)


def test_k_means_of_a_table_is_that_of_its_rows(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0.0, 4.0, 9.0)])
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    found = {r.id: r.cluster for r in gr.k_means_table(rows, 3, key="id", vector="v", starts=4).collect()}
    here = gr.k_means(x, 3, starts=4)
    assert [found[i] for i in range(120)] == here.tolist() == [0] * 40 + [1] * 40 + [2] * 40


@pytest.mark.parametrize("leaf, n", [(1 << 18, 2), (8, 2), (8, 3), (16, 4), (8, 1)])
def test_fronts_are_those_of_peeling(spark, monkeypatch, leaf, n):
    monkeypatch.setattr(dp, "CHAIN_ROWS", leaf)
    monkeypatch.setattr(dp, "CHAIN_BLOCK", leaf)
    rng = np.random.default_rng(n)
    x = rng.integers(0, 6, (70, n)).astype(float)
    names = tuple(f"o{k}" for k in range(n))
    rows = [(i, *(float(c) for c in v)) for i, v in enumerate(x)] + [(100, *(None,) * n)]
    got = {r.item_id: r.front for r in dp.fronts(spark.createDataFrame(rows, "item_id long, " + ", ".join(f"{o} double" for o in names)), names).collect()}
    want, left, front = {100: 1}, set(range(len(x))), 1
    while left:
        best = {i for i in left if not any((x[j] >= x[i]).all() and (x[j] > x[i]).any() for j in left)}
        want |= dict.fromkeys(best, front)
        left, front = left - best, front + 1
    assert got == want and max(want.values()) > 2


def test_fronts_of_a_hundred_thousand_on_one_chain(spark):
    chain = spark.range(100_000).selectExpr("id AS item_id", "cast(id AS double) AS x", "cast(id div 2 AS double) AS y")
    assert dp.fronts(chain, ("x", "y")).where("front <> 100000 - item_id").count() == 0
    assert dp.fronts(chain.limit(0), ("x", "y")).count() == 0


def test_fronts_of_a_long_chain_and_of_many_items(spark):
    chain = spark.range(12).selectExpr("id AS item_id", "cast(id AS double) AS x", "cast(id AS double) AS y")
    assert {r.item_id: r.front for r in dp.fronts(chain, ("x", "y")).collect()} == {i: 12 - i for i in range(12)}
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    items = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(900, None, 1.0, 1.0)], "item_id long, a double, b double, c double")
    want = {i for i, v in enumerate(x) if not ((x >= v).all(axis=1) & (x > v).any(axis=1)).any()} | {900}
    assert {r.item_id for r in dp.first_front(items, ("a", "b", "c")).collect()} == want


def test_seeded_order_is_that_of_the_shuffle(spark):
    import random

    ids = [f"s{i * 7 % 50}" for i in range(50)]
    want = sorted(ids)
    random.Random(9).shuffle(want)
    got = sorted((r.place, r.sample_id) for r in mf._order(spark.createDataFrame([(i,) for i in ids], "sample_id string"), 9, "sample_id").collect())
    assert [i for _, i in got] == want


def test_bootstrap_beyond_the_held_tasks_draws_the_same(spark):
    t = spark.createDataFrame([(i, float(i * i % 7)) for i in range(20)], "sample_id long, value double")
    few, many = ({r.b: r["mean"] for r in ev.bootstrap_means(t, samples=70, batch=16, held=n).collect()} for n in (100, 5))
    assert few.keys() == many.keys() and all(abs(few[b] - many[b]) < 1e-12 for b in few)
    rng = np.random.default_rng(3)
    draws = [np.bincount(rng.integers(0, 20, size=20), minlength=20) for _ in range(70)]
    got = {(r.b, r.task): r.times for r in ev.resample_counts(spark, 20, 70, 3, batch=16).collect()}
    assert got == {(b, k): n for b, d in enumerate(draws) for k, n in enumerate(d.tolist()) if n}


def test_splits_of_many_sequences_are_those_of_a_plain_recursion():
    rng = np.random.default_rng(6)
    tables = [sg.segment_costs(rng.standard_normal((n, 3)).round(1), 4) for n in (1, 2, 5, 9, 14, 14)]
    for penalty in (0.0, 0.2, 0.7, 3.0):
        for c, got in zip(tables, sg.split_all(tables, penalty)):
            memo = {0: (0.0, [])}
            for end in range(1, len(c)):
                memo[end] = min(((memo[end - n][0] + c[end, n] + penalty, memo[end - n][1] + [(end - n, end - 1)]) for n in range(1, min(4, end) + 1)), key=lambda r: r[0])
            assert sum(c[b + 1, b - a + 1] + penalty for a, b in got) == pytest.approx(memo[len(c) - 1][0], abs=1e-9)
            assert [a for a, _ in got] == [0, *[b + 1 for _, b in got[:-1]]] and got[-1][1] == len(c) - 2


def test_penalties_of_unknown_ids_or_below_zero_raise(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    x = spark.createDataFrame([("a", [1.0, 0.0])], "skill_id string, vector array<double>")
    for bad in (("z", 0.1), ("a", -0.1)):
        with pytest.raises(ValueError):
            rt.search(q, x, 1, penalties=spark.createDataFrame([bad], "skill_id string, penalty double"))


RESULT, KEY = "sample_id long, shard int, primary_score double, error string", ("sample_id",)


def test_checkpoint_recovers_and_refuses(spark, tmp_path):
    path = tmp_path / "results"
    path.mkdir()
    first = '{"sample_id": 1000, "shard": 0, "primary_score": 0.5, "error": null}\n'
    (path / "a.json").write_text(first + '{"sample_id": 10')
    wanted = spark.createDataFrame([(1000,), (1001,)], "sample_id long")
    done = rn.completed(spark, str(path), RESULT, KEY)
    assert [r.sample_id for r in rn.pending(wanted, done, KEY).collect()] == [1001]
    (path / "b.json").write_text(first)
    with pytest.raises(ValueError, match="twice"):
        rn.completed(spark, str(path), RESULT, KEY)
    (path / "b.json").write_text('{"sample_id": 7, "shard": 0, "primary_score": null, "error": "x"}\n')
    with pytest.raises(ValueError, match="no result"):
        rn.completed(spark, str(path), RESULT, KEY)
    (path / "b.json").write_text("broken\n" + first)
    with pytest.raises(Exception):  # noqa: B017 - Spark's own error
        rn.completed(spark, str(path), RESULT, KEY)


def test_runner_resumes_only_what_failed(spark, tmp_path):
    manifest = spark.range(6).withColumnRenamed("id", "sample_id")
    give = lambda row: {"sample_id": row["sample_id"], "shard": row["shard"], "primary_score": 1.0}

    def interrupted(row):
        if row["sample_id"] == 3:
            raise ConnectionError("simulated")
        return give(row) | ({"shard": 9} if row["sample_id"] == 4 else {})

    none = rn.completed(spark, None, RESULT, KEY)
    dry = rn.run_shards(manifest, none, interrupted, key=KEY, of=1, dry_run=True)[2].first()
    assert (dry.selected, dry.skipped, dry.completed, dry.failed) == (6, 0, 0, 0)
    results, errors, summary = rn.run_shards(manifest, none, interrupted, key=KEY, of=1)
    assert tuple(summary.first()) == (0, 6, 0, 4, 2)
    assert {r.sample_id: r.error.split(":")[0] for r in errors.collect()} == {3: "ConnectionError", 4: "ValueError"}
    rn.append(results, str(tmp_path / "log"))
    done = rn.completed(spark, str(tmp_path / "log"), RESULT, KEY)
    again, errors, summary = rn.run_shards(manifest, done, give, key=KEY, of=1)
    assert tuple(summary.first()) == (0, 6, 4, 2, 0) and sorted(r.sample_id for r in again.collect()) == [3, 4] and errors.count() == 0
    with pytest.raises(ValueError):
        rn.run_shards(manifest, done, give, key=KEY, of=1, most=0)


def test_clickable_types_come_before_exclusion(spark):
    rows = [
        ("t", 0, "search_action", "ring", None, None), ("t", 1, "click_action", None, "Filter", {"B012345678": "product_link", "Filter": "other"}), ("t", 2, "click_action", None, "b012345678", {"B012345678": "product_link"}),
        ("t", 3, "click_action", None, "Wish list", {"red": "option"}), ("t", 4, "click_action", None, "RED", {"red": "option"}), ("t", 5, "click_action", None, "a thing", None), ("t", 6, "click_action", None, "Buy Now", None),
    ]
    steps = spark.createDataFrame(rows, "trajectory_id string, step_index int, tool string, keywords string, value string, clickable_types map<string,string>")
    want = ["query_formulation", "other_click", "candidate_selection", "other_click", "option_selection", "option_selection", "purchase_decision"]
    assert [r.shop_event for r in lb.classify_shop(steps).orderBy("step_index").collect()] == want


def test_rows_are_numbered_by_file_and_place(spark, tmp_path):
    spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").selectExpr("struct(id AS task, 'x' AS other) AS info").write.parquet(f"{tmp_path}/t")
    rows = fs.read_numbered(spark, f"{tmp_path}/t", "info.task")
    assert rows.columns == ["dataset_index", "task"] and rows.where("dataset_index <> task").count() == 0 and rows.count() == 1000
    spark.range(0).selectExpr("id AS task").write.parquet(f"{tmp_path}/none")
    assert fs.read_numbered(spark, f"{tmp_path}/none", "task").count() == 0


def test_a_pool_reports_what_it_writes(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 3 AS kind")
    report = fs.write_pool(rows, f"{tmp_path}/pool", n=F.count("*"), kinds=F.max("kind"))
    assert report == {"n": 100, "kinds": 2} and spark.read.parquet(f"{tmp_path}/pool").count() == 100


def test_stored_matrices_are_summed_without_a_shuffle(spark):
    from loomtrace.sources import graph_store as gs

    edges = spark.createDataFrame([(1, 2, *[float(k) for k in range(7)]), (1, 3, *[0.5] * 6, 0.0), (2, 3, *[1.0] * 6, -2.0)], "i long, j long, " + ", ".join(f"{m} double" for m in gs.MATRICES))
    stored = gs.store_matrices(edges, buckets=4)
    assert stored.count() == 6
    degrees = gs.degrees(stored)
    assert {tuple(r) for r in degrees.collect()} == {(1, 1, 6.0), (2, 2, 8.0), (3, 1, 2.0)}
    joined = stored.join(degrees, "i")
    assert joined.count() == 6
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(degrees)
    values, vectors = gs.store_spectrum(spark, np.array([7, 9]), np.array([0.0, 0.5]), np.eye(2))
    assert {tuple(r) for r in values.collect()} == {(0, 0.0), (1, 0.5)} and {r.segment_id: r.vector for r in vectors.collect()} == {7: [1.0, 0.0], 9: [0.0, 1.0]}


def test_a_fixed_context_is_a_source(spark, tmp_path):
    from loomtrace.sources import provider as pv

    (tmp_path / "guide.txt").write_text("  First look.\nThen act.\n")
    rows = pv.provided(spark, "guide", pv.context_of(spark, f"file://{tmp_path}/guide.txt"))
    assert [tuple(r) for r in rows.collect()] == [("guide", "First look.\nThen act.")]
    assert pv.select_fixed(spark.range(3), rows).select("id", "skill_ids").collect()[0].skill_ids == ["guide"]
    for skill, context in (("", "x"), ("guide", "  ")):
        with pytest.raises(Exception, match="must not be empty"):
            pv.provided(spark, skill, context).collect()


def test_structural_proposals_are_gated_and_dominate(spark):
    from loomtrace.operators import structural as sr

    rows = []  # segment, old, new, outcome, event, vector
    for k in range(40):
        rows.append((k, 1, 10 + k % 2, float(k % 2), k % 2, [1.0, float(k % 2)]))  # a clean split
        rows.append((100 + k, 2 + k % 2, 20, 1.0, 5, [1.0, 0.0]))  # a merge that changes nothing
        rows.append((200 + k, 4, None if k < 10 else 30 + k % 2, float(k % 2), k % 2, [1.0, float(k % 2)]))  # a split that loses a quarter
        rows.append((300 + k, 5 + k % 2, 40, float(k % 2), 0, [1.0, float(k % 2)]))  # a merge that mixes
        rows.append((400 + k, 7, 50, 1.0, 0, [0.0, 1.0]))  # goes on
    t = spark.createDataFrame(rows, "segment_id long, old_id long, new_id long, outcome double, event_type long, embedding array<double>")
    old, new = t.select("segment_id", "old_id"), t.where("new_id is not null").select("segment_id", "new_id")
    found = sr.proposals(old, new, t.select("segment_id", "outcome", "event_type", "embedding"))
    assert [(r.component, r.action, r.outcome_gain, r.role_gain, r.front) for r in found.collect()] == [("a000000000001", "split", 0.5, 0.5, 1)]
    looser = sr.proposals(old, new, t.select("segment_id", "outcome", "event_type", "embedding"), coverage=0.7)
    assert {r.component for r in looser.collect()} == {"a000000000001", "a000000000004"} and sr.selected(looser).collect()[0].component == "a000000000001"
    with pytest.raises(ValueError, match="without evidence"):
        sr.proposals(old, new, t.where("segment_id > 3").select("segment_id", "outcome", "event_type", "embedding"))


def test_shadow_split_covers_its_source(spark):
    from loomtrace.operators import structural as sr

    v = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [1.0, 0.1], 4: [0.1, 1.0], 5: [1.0, 1.0], 6: [1.0, 0.0], 7: [0.0, 1.0]}
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    members, centres = sr.shadow_split(
        t([(1,), (2,), (3,), (4,), (5,)], "segment_id long"), t([(1, "t1", "x"), (2, "t1", "y"), (6, "old", "x"), (7, "new", "y")], "segment_id long, trajectory_id string, child string"), t([("t1",), ("old",)], "trajectory_id string"),
        t(list(v.items()), "segment_id long, vector array<double>"), t([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "child string, centroid array<double>"),
    )
    assert {tuple(r) for r in members.collect()} == {("x", 1, False), ("y", 2, False), ("y", 7, False), ("x", 3, True), ("y", 4, True), ("y", 5, True)}
    assert {r.child: r.centroid for r in centres.collect()} == {"x": pytest.approx([1.0, 0.05]), "y": pytest.approx([0.275, 1.0])}
