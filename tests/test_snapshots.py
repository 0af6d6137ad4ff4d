"""Integrity rules of snapshots, each broken on its own, and digests that know no order."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import snapshots as sn


@pytest.fixture(scope="module")
def whole(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    hashed = lambda ids: t([(i, "h" + i) for i in ids], "skill_id string, text_hash string")
    members = [("m1", "t1:s0", "t1"), ("m1", "t2:s0", "t2"), ("m2", "t1:s1", "t1"), ("m3", "t2:s1", "t2")]
    steps = [("p1", 0, "m1"), ("p1", 1, "m2"), ("p2", 0, "m1"), ("p2", 1, "m3"), ("p2", 2, "m1")]
    v1 = sn.Snapshot(
        training=t([("t1",), ("t2",)], "trajectory_id string"), clusters=t([("m1",), ("m2",), ("m3",)], "cluster_id string"), cluster_members=t(members, "cluster_id string, segment_id string, trajectory_id string"),
        paths=t([("p1",), ("p2",)], "path_id string"), path_steps=t(steps, "path_id string, place int, mid_id string"), path_support=t([("p1", "t1"), ("p2", "t2")], "path_id string, trajectory_id string"),
        mid_cards=hashed(["m1", "m2", "m3"]), mid_card_members=t([m[:2] for m in members], "skill_id string, segment_id string"), high_cards=hashed(["p1", "p2"]), high_card_steps=t(steps, "skill_id string, place int, mid_id string"),
        mid_index=hashed(["m1", "m2", "m3"]), high_index=hashed(["p1", "p2"]), source_hashes=dict.fromkeys(sn.SOURCES, "0" * 64),
    )
    mids = [("c1", "m1"), ("c1", "m2"), ("c2", "m1"), ("c2", "m3")]
    v2 = replace(
        v1, version="v2", communities=t([("c1",), ("c2",)], "community_id string"), community_mids=t(mids, "community_id string, mid_id string"), community_paths=t([("c1", "p1"), ("c2", "p2")], "community_id string, path_id string"),
        community_support=t([("c1", "t1"), ("c2", "t2")], "community_id string, trajectory_id string"), high_cards=hashed(["c1", "c2"]), high_index=hashed(["c1", "c2"]),
        high_card_steps=t([("c1", 0, "m1"), ("c1", 1, "m2")], "skill_id string, place int, mid_id string"), high_card_mids=t(mids, "skill_id string, mid_id string"),
    )
    return {"v1": v1, "v2": v2}


def broken(s):
    return {(r.rule, r.id) for r in sn.violations(s).collect()}


def plus(rows, *new):
    return rows.unionByName(rows.sparkSession.createDataFrame(list(new), rows.schema))


CASES = [
    ("v1", lambda s: {"training": plus(s.training, ("t1",))}, {("training trajectories repeat", "t1")}),
    ("v1", lambda s: {"clusters": plus(s.clusters, ("m1",)), "paths": plus(s.paths, ("p2",))}, {("cluster ids repeat", "m1"), ("path ids repeat", "p2")}),
    ("v1", lambda s: {"training": s.training.where("trajectory_id = 't1'")}, {("segment outside training", "t2:s0"), ("segment outside training", "t2:s1"), ("path support outside training", "p2")}),
    ("v1", lambda s: {"mid_cards": plus(s.mid_cards, ("m9", "h")), "mid_index": plus(s.mid_index, ("m9", "h"))}, {("mid card without cluster", "m9"), ("mid coverage flag", "mid_coverage_complete")}),
    ("v1", lambda s: {"mid_card_members": s.mid_card_members.where("segment_id <> 't2:s0'")}, {("mid card members differ", "m1")}),
    ("v1", lambda s: {"path_steps": s.path_steps.where("path_id <> 'p1' or place = 0")}, {("path length", "p1"), ("high card order differs from path", "p1")}),
    ("v1", lambda s: {"longest_path": 2}, {("path length", "p2")}),
    ("v1", lambda s: {"high_card_steps": s.high_card_steps.withColumn("mid_id", F.when(F.col("skill_id") == "p1", F.lit("m9")).otherwise(F.col("mid_id")))}, {("high card order differs from path", "p1"), ("high card without child card", "p1")}),
    ("v1", lambda s: {"mid_index": plus(s.mid_index.where("skill_id <> 'm2'"), ("m7", None))}, {("mid index and cards differ", "m2"), ("mid index and cards differ", "m7"), ("index without text hash", "m7")}),
    ("v1", lambda s: {"high_coverage_complete": False, "source_hashes": s.source_hashes | {"clusters": "X" * 64}}, {("high coverage flag", "high_coverage_complete"), ("source hash is no SHA-256", "clusters")}),
    ("v2", lambda s: {"high_cards": plus(s.high_cards, ("p1", "h"))}, {("high card without structure", "p1"), ("high index and cards differ", "p1"), ("high coverage flag", "high_coverage_complete")}),
    ("v2", lambda s: {"community_mids": plus(s.community_mids, ("c1", "m9"))}, {("community mid without cluster", "c1"), ("high card members differ", "c1")}),
    ("v2", lambda s: {"community_paths": plus(s.community_paths, ("c2", "p9")), "community_support": plus(s.community_support, ("c2", "t9"))}, {("community path without path", "c2"), ("community support outside training", "c2")}),
    ("v2", lambda s: {"high_card_steps": s.high_card_steps.withColumn("place", 1 - F.col("place"))}, {("high card order without a member path", "c1")}),
    ("v2", lambda s: {"high_card_mids": plus(s.high_card_mids, ("c2", "m8"))}, {("high card members differ", "c2"), ("high card without child card", "c2")}),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_each_rule(whole, k):
    version, change, want = CASES[k]
    assert broken(replace(whole[version], **change(whole[version]))) == want


def test_whole_snapshots_break_nothing(whole):
    for s in whole.values():
        sn.require_valid(s)
    with pytest.raises(ValueError, match="does not match"):
        sn.require_valid(whole["v1"], "tower_0000000000000000")
    with pytest.raises(ValueError, match="snapshot"):
        sn.require_valid(replace(whole["v1"], longest_path=1))


@pytest.mark.parametrize("leaf", [1024, 2])
def test_digests_know_no_order_but_every_row(spark, leaf):
    rows = spark.range(700).selectExpr("id % 650 AS a", "CASE WHEN id % 7 <> 0 THEN id % 650 END AS b")
    digest = lambda df: tuple(sn.digest_tree(df, leaf_rows=leaf).first())
    want = digest(rows)
    assert want[1] == 700 and digest(rows.orderBy(F.desc("a")).repartition(3)) == want == digest(rows.select("b", "a"))
    others = [rows.where("a <> 649"), rows.unionByName(rows.limit(1)), rows.withColumn("b", F.coalesce("b", F.lit(-1))), rows.limit(0)]
    assert len({want, *map(digest, others)}) == 5


def test_content_id_is_of_the_content(whole):
    s = whole["v1"]
    assert sn.content_id(s) == sn.content_id(replace(s, path_steps=s.path_steps.orderBy(F.desc("place"))))
    assert sn.content_id(s) != sn.content_id(replace(s, path_steps=s.path_steps.where("place < 2")))
