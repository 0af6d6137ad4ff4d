"""Snapshots of a skill library as flat tables: integrity rules as joins, and a content id from a digest tree.

No row holds a list that grows with the data: members, steps and supports are tables of their own, so every rule is a join or a grouped
count. A rule returns the ids that break it.

The digest of a table (:func:`digest_tree`) does not depend on the order of its rows: equal rows are counted, digests of rows are
dealt by their first digits, each bucket is hashed in the order of its digests, and the buckets' hashes are hashed again, a
level of 256 at a time. No task sees more than a bucket.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validation import require_empty

#: Rows of one bucket of a digest tree, about.
LEAF_ROWS = 1024
#: Names of sources whose SHA-256 a snapshot records (fixed values).
SOURCES = ("preprocessed_trajectories", "clusters", "high_paths", "rendered_cards", "retrieval_index")


@dataclass(frozen=True)
class Snapshot:
    """Tables of a snapshot. ``v2`` snapshots have communities, and their high cards stand for these; others' stand for paths."""

    training: DataFrame  # trajectory_id
    clusters: DataFrame  # cluster_id
    cluster_members: DataFrame  # cluster_id, segment_id, trajectory_id
    paths: DataFrame  # path_id
    path_steps: DataFrame  # path_id, place, mid_id
    path_support: DataFrame  # path_id, trajectory_id
    mid_cards: DataFrame  # skill_id, text_hash
    mid_card_members: DataFrame  # skill_id, segment_id
    high_cards: DataFrame  # skill_id, text_hash
    high_card_steps: DataFrame  # skill_id, place, mid_id
    mid_index: DataFrame  # skill_id, text_hash
    high_index: DataFrame  # skill_id, text_hash
    communities: DataFrame | None = None  # community_id
    community_mids: DataFrame | None = None  # community_id, mid_id
    community_paths: DataFrame | None = None  # community_id, path_id
    community_support: DataFrame | None = None  # community_id, trajectory_id
    high_card_mids: DataFrame | None = None  # skill_id, mid_id
    version: str = "v1"
    longest_path: int = 8
    mid_coverage_complete: bool = True
    high_coverage_complete: bool = True
    source_hashes: dict[str, str] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if isinstance(getattr(self, f.name), DataFrame)}


def _ids(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).cast("string").alias("id"))


def _without(child: DataFrame, column: str, parent: DataFrame, parent_column: str, name: str | None = None) -> DataFrame:
    """Ids (of column ``name``) of child rows whose reference has no target."""
    parents = parent.select(F.col(parent_column).alias("_p")).distinct()
    return _ids(child.join(parents, F.col(column) == F.col("_p"), "left_anti"), name or column)


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    return _ids(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), key)


def _differing(left: DataFrame, right: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys for which two tables do not hold the same rows of (key, columns)."""
    a, b = left.select(key, *columns).distinct(), right.select(key, *columns).distinct()
    on = lambda x, y: [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (key, *columns)]
    half = lambda x, y: x.alias("x").join(y.alias("y"), on(x, y), "left_anti")
    return _ids(half(a, b).unionByName(half(b, a)), key)


def _of(rows: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    return rows.join(ids.select(F.col(id_column).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")


def _ordered(rows: DataFrame, key: str) -> DataFrame:
    """(key, steps): short sequences as arrays, by place."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mid_id"))), lambda s: s["mid_id"]).alias("steps"))


def violations(s: Snapshot) -> DataFrame:
    """(rule, id): what breaks the integrity of a snapshot, each id once a rule."""
    v2 = s.version == "v2"
    spark = s.training.sparkSession
    flag = lambda broken, text: spark.createDataFrame([(text,)] if broken else [], "id string")
    hexed = [n for n in SOURCES if not (len(s.source_hashes.get(n, "")) == 64 and set(s.source_hashes[n]) <= set("0123456789abcdef"))]
    lengths = s.paths.join(s.path_steps.groupBy(F.col("path_id").alias("_p")).agg(F.count("*").alias("_n"), F.count_distinct("mid_id").alias("_d")), F.col("path_id") == F.col("_p"), "left")
    target, target_id = (s.communities, "community_id") if v2 else (s.paths, "path_id")
    children = s.high_card_steps.select("skill_id", "mid_id")
    if v2:
        # A card without an order of its own has its members for children.
        children = children.unionByName(s.high_card_mids.join(s.high_card_steps.select(F.col("skill_id").alias("_s")).distinct(), F.col("skill_id") == F.col("_s"), "left_anti"))
    covered = lambda cards, of, column: _without(of, column, cards, "skill_id").isEmpty() and _without(cards, "skill_id", of, column).isEmpty()
    renamed = lambda rows, column: rows.withColumnRenamed(column, "skill_id")
    both = lambda rows, cards, of, column: _of(_of(rows, "skill_id", cards, "skill_id"), "skill_id", of, column)  # noqa: E731 - ids that have a card and a structure
    rules = {
        "training trajectories repeat": _repeated(s.training, "trajectory_id"),
        "no training trajectories": flag(s.training.isEmpty(), "training"),
        "source hash is no SHA-256": spark.createDataFrame([(n,) for n in hexed], "id string"),
        "cluster ids repeat": _repeated(s.clusters, "cluster_id"), "path ids repeat": _repeated(s.paths, "path_id"),
        "mid card ids repeat": _repeated(s.mid_cards, "skill_id"), "high card ids repeat": _repeated(s.high_cards, "skill_id"),
        "mid card without cluster": _without(s.mid_cards, "skill_id", s.clusters, "cluster_id"),
        "high card without structure": _without(s.high_cards, "skill_id", target, target_id) if target is not None else _ids(s.high_cards, "skill_id"),
        "segment outside training": _without(s.cluster_members, "trajectory_id", s.training, "trajectory_id", "segment_id"),
        "path support outside training": _without(s.path_support, "trajectory_id", s.training, "trajectory_id", "path_id"),
        "path length": _ids(lengths.where(f"coalesce(_n, 0) < 2 or _n > {s.longest_path} or coalesce(_d, 0) < 2"), "path_id"),
        "mid card members differ": _differing(both(renamed(s.cluster_members, "cluster_id"), s.mid_cards, s.clusters, "cluster_id"), both(s.mid_card_members, s.mid_cards, s.clusters, "cluster_id"), "skill_id", "segment_id"),
        "high card without child card": _without(children, "mid_id", s.mid_cards, "skill_id", "skill_id"),
        "mid index and cards differ": _without(s.mid_index, "skill_id", s.mid_cards, "skill_id").unionByName(_without(s.mid_cards, "skill_id", s.mid_index, "skill_id")),
        "high index and cards differ": _without(s.high_index, "skill_id", s.high_cards, "skill_id").unionByName(_without(s.high_cards, "skill_id", s.high_index, "skill_id")),
        "index without text hash": _ids(s.mid_index.where("text_hash is null or text_hash = ''"), "skill_id").unionByName(_ids(s.high_index.where("text_hash is null or text_hash = ''"), "skill_id")),
        "mid coverage flag": flag(covered(s.mid_cards, s.clusters, "cluster_id") != s.mid_coverage_complete, "mid_coverage_complete"),
        "high coverage flag": flag(target is not None and covered(s.high_cards, target, target_id) != s.high_coverage_complete, "high_coverage_complete"),
    }
    if v2:
        orders = _ordered(s.high_card_steps, "skill_id")
        theirs = s.community_paths.join(_ordered(s.path_steps, "path_id"), "path_id").select(F.col("community_id").alias("_c"), F.col("steps").alias("_steps"))
        rules |= {
            "no communities": flag(s.communities.isEmpty(), "communities"), "community ids repeat": _repeated(s.communities, "community_id"),
            "community mid without cluster": _without(s.community_mids, "mid_id", s.clusters, "cluster_id", "community_id"),
            "community path without path": _without(s.community_paths, "path_id", s.paths, "path_id", "community_id"),
            "community support outside training": _without(s.community_support, "trajectory_id", s.training, "trajectory_id", "community_id"),
            "high card members differ": _differing(both(renamed(s.community_mids, "community_id"), s.high_cards, s.communities, "community_id"), both(s.high_card_mids, s.high_cards, s.communities, "community_id"), "skill_id", "mid_id"),
            "high card order without a member path": _ids(orders.join(theirs, (F.col("skill_id") == F.col("_c")) & (F.col("steps") == F.col("_steps")), "left_anti"), "skill_id"),
        }
    else:
        rules |= {
            "communities in a version without them": flag(s.communities is not None and not s.communities.isEmpty(), "communities"),
            "high card order differs from path": _differing(both(renamed(s.path_steps, "path_id"), s.high_cards, s.paths, "path_id"), both(s.high_card_steps, s.high_cards, s.paths, "path_id"), "skill_id", "place", "mid_id"),
        }
    out = None
    for name, ids in rules.items():
        part = ids.distinct().select(F.lit(name).alias("rule"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def _hashed(level: DataFrame) -> DataFrame:
    """(name, line, n) of each bucket of (bucket, name, line, n): its lines in the order of their names, hashed as they stream by, so a bucket may be
    of any size."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total, running = None, 0, hashlib.sha256()
        done = lambda: pa.RecordBatch.from_pylist([{"name": bucket, "line": running.hexdigest(), "n": total}])
        for b in batches:
            for name, line, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "line", "n"))):
                if name != bucket:
                    if bucket is not None:
                        yield done()
                    bucket, total, running = name, 0, hashlib.sha256()
                elif total:
                    running.update(b"\n")
                running.update(line.encode())
                total += n
        if bucket is not None:
            yield done()

    return level.repartition("bucket").sortWithinPartitions("bucket", "name").select("bucket", "line", "n").mapInArrow(stream, "name string, line string, n long")


def digest_tree(rows: DataFrame, *, leaf_rows: int = LEAF_ROWS, deepest: int | None = None) -> DataFrame:
    """One row (digest, n): SHA-256 of a table's rows whatever their order, and their number. Rows are told by their canonical JSON over the
    columns in the order of their names; nulls are values. ``deepest`` bounds the tree's levels of buckets; buckets then hold more rows."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)
    entries = rows.select(row.alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    distinct, depth = entries.count(), 0
    while distinct > leaf_rows * 256**depth and (deepest is None or depth < deepest):
        depth += 1
    # Entries are (name, digest, n); each level hashes those whose names begin alike.
    level = entries.select(F.col("d").alias("name"), F.concat_ws(":", "d", "n").alias("line"), "n")
    for k in range(depth, -1, -1):
        if k == depth == deepest:  # buckets of any size
            level = _hashed(level.select(F.substring("name", 1, 2 * k).alias("bucket"), "name", "line", "n"))
            continue
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "line"))), lambda e: e["line"]), "\n")
        level = level.groupBy(F.substring("name", 1, 2 * k).alias("name")).agg(F.sha2(lines, 256).alias("line"), F.sum("n").alias("n"))
    empty = rows.sparkSession.range(1).select(F.lit(hashlib.sha256(b"").hexdigest()).alias("digest"), F.lit(0).cast("long").alias("n"))
    return level.select(F.col("line").alias("digest"), "n").unionByName(empty).orderBy(F.desc("n")).limit(1)


def content_id(s: Snapshot) -> str:
    """The snapshot's id: a hash of its tables' digests, which do not depend on orders, and of its settings."""
    record: dict = {name: list(digest_tree(rows).first()) for name, rows in s.tables().items()}
    record |= {"version": s.version, "longest_path": s.longest_path, "mid_coverage_complete": s.mid_coverage_complete, "high_coverage_complete": s.high_coverage_complete, "source_hashes": s.source_hashes}
    return "tower_" + hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def require_valid(s: Snapshot, snapshot_id: str = "") -> None:
    """Raise if a rule is broken, or if ``snapshot_id`` is given and is not the content's."""
    require_empty(violations(s), "snapshot")
    if snapshot_id and snapshot_id != content_id(s):
        raise ValueError("the snapshot id does not match its contents")


def text_hash(*columns: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *columns), 256)
