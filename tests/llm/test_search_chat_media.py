import hashlib
import json
import math
import tarfile
import zlib
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import chat_format, media, shared, topk_search


def brute(rows, every, k):
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, a) in enumerate(fit):
        if i % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), j) for m, (j, b) in enumerate(fit) if m != n and len(a) == len(b))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, score int").select("*")


@pytest.mark.parametrize("shard_rows", [8, 64, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk_search, "LEAF_ROWS", 4)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk_search, "ROOT_ROWS", 3)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((180, 6)).round(2)
    v[20:60] = v[20]  # ties and one common vector
    v[150:160] *= 1000
    rows = [(int(i), [float(np.float32(x)) for x in v[i]], None, None) for i in range(180)]
    rows += [(200, None, None, None), (201, [1.0, None, 2.0, 0.0, 0.0, 0.0], None, None), (202, [float("nan")] * 6, None, None), (203, [], None, None), (None, [1.0] * 6, None, None), (10, [0.5] * 6, None, None), (210, [1.0, 2.0], None, None), (220, [], None, None)]
    rows += [(30, rows[30][1], None, None)] * 3 + [(11, [1e6, 2.5e5, -7e5, 3.0, 0.25, 1.0], None, None), (250, [3e5] * 6, None, None), (12, [-1e-20, 1e-20, -0.0, 0.5, -3.0, 2.0], None, None)]
    got = topk_search.top_k(table(spark, rows), k=5, every=10)
    assert sorted(tuple(r) for r in got.collect()) == brute([r[:2] for r in rows], 10, 5)


def test_huge_components_are_exact_or_raise(spark):
    big = [float(np.float32(x)) for x in (3e6, 7e6, -2e6, 1.0)]
    rows = [(0, big, None, None), (1, [big[0] + 1, *big[1:]], None, None), (2, [1.0, 2.0, 3.0, 4.0], None, None), (3, big, None, None)]
    got = topk_search.top_k(table(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute([r[:2] for r in rows], 50, 5)
    with pytest.raises(Exception, match="does not fit a long"):
        topk_search.top_k(table(spark, [(0, [1e20], None, None), (1, [1e20], None, None)])).collect()


def test_branch_and_bound_cuts_subtrees():
    """Well separated groups: few leaves are read, and none that holds a better row is missed."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((2000, 8)) + 100 * np.eye(8)[rng.integers(0, 8, 2000)])
    tree = topk_search.BallTree(np.arange(2000), np.arange(2000), x)
    read, of = [], topk_search.dot
    try:
        topk_search.dot = lambda a, b, exact: read.append(a.shape[0] * b.shape[0]) or of(a, b, exact)
        score, _ = tree.search(np.arange(50), x[:50], 5, np.full(50, -np.inf))
    finally:
        topk_search.dot = of
    full = x[:50] @ x.T
    full[np.arange(50), np.arange(50)] = -np.inf
    assert (score == -np.sort(-full, axis=1)[:, :5]).all() and sum(read) < 0.4 * full.size


def test_top_k_of_few_and_no_rows(spark):
    assert topk_search.top_k(table(spark, [])).count() == 0
    got = topk_search.top_k(table(spark, [(0, [1.0], None, None), (1, [2.0], None, None)])).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 512)]


CHATS = "conv_id long, turn long, role string, text string, id string, record string"


def test_chat_round_trip_and_loss_mask(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<!|x", "a<!!|<|", "", None, "<", "|", "line\nline", '{"json": [1]}', "\\u0000 \t", "😀" * 3]
    rows = [(c, t, ["system", "user", "assistant"][(c + t) % 3], odd[(c * 3 + t) % len(odd)], "i", "r") for c in range(25) for t in range(1 + c % 6)]
    rows += [(100, 0, "human", "x", None, None), (100, 1, "gpt", "y", None, None), (101, 0, "user", "q", None, None), (101, 1, "assistant", "a<|im_end|>", None, None), (102, None, None, None, None, None), (None, 0, "user", "no id", None, None), (103, 5, "assistant", "tie", None, None), (103, 5, "assistant", "tie", None, None)]
    rows += [(110 + i, 0, r, "t", None, None) for i, r in enumerate(("a\nb", "\n", "<n|", "<nn|\n<\n|", "<!n|<|n", "<n", "|\n<n<n||", "<!|\r\n"))]
    turns = spark.createDataFrame(rows, CHATS)
    done = chat_format.format_records(chat_format.records_of(turns).withColumnRenamed("conv_id", "id"), key="id").collect()
    back = chat_format.digests(spark.createDataFrame(done).withColumnRenamed("id", "conv_id")).collect()
    by = {}
    for c, t, r, x, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert {b.conv_id: (b.n_turns, b.turns_sha256, b.loss_chars, b.loss_sha256) for b in back} == {
        c: (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(), sum(len(x) for r, x in t if r == "assistant"), hashlib.sha256("".join(x for r, x in t if r == "assistant").encode()).hexdigest()) for c, t in by.items()
    }
    for d in done:
        inside = d.formatted.replace(chat_format.START, "").replace(chat_format.END, "")
        assert "<|" not in inside
        assert d.layout is not None


def test_fingerprints_select_each_layout_and_unknown_records_are_kept(spark):
    records = {
        "prompt": {"id": "1", "prompt": "p", "response": "r"}, "system prompt": {"id": "1", "system": "s", "prompt": "p", "response": "r"}, "instruction": {"instruction": "i", "id": "1", "output": "o"},
        "messages": {"id": "1", "messages": [{"role": "user", "content": "c"}]}, "messages in body": {"id": "1", "body": {"messages": [{"content": "c", "role": "user"}]}}, "from and value": {"id": "1", "conversations": [{"from": "human", "value": "v"}]},
        None: {"id": "1", "weird": [[{"a": 1}], []]},
    }
    partly = {"messages?": [{"id": "1", "messages": []}, {"messages": [{"role": "user", "content": "c", "name": "n"}], "id": "1"}], "prompt?": [{"prompt": "p", "response": "r", "extra": {"k": [1]}}]}
    rows = [(i, json.dumps(r)) for i, r in enumerate(records.values())] + [(50, "not json"), (51, None)]
    got = {r.id: r for r in chat_format.format_records(spark.createDataFrame(rows, "id long, record string")).collect()}
    assert [got[i].layout for i in range(len(records))] == list(records)
    assert got[50].layout is None and got[51].layout is None and got[50].formatted == ""
    more = spark.createDataFrame([(layout, json.dumps(r)) for layout, rs in partly.items() for r in rs], "id string, record string")
    done = chat_format.format_records(more).collect()
    assert all(r.layout == r.id for r in done) and sorted(r.formatted.count(chat_format.START) for r in done) == [0, 1, 2]
    assert {r.id for r in chat_format.unread(chat_format.format_records(spark.createDataFrame(rows, "id long, record string"))).collect()} == {len(records) - 1, 50, 51}


def test_field_paths_of_nested_records(spark):
    r = spark.createDataFrame([('{"a": {"b": [{"c": 1, "d": {"e": "x"}}]}, "f": [1, 2], "we:ird": null}',)], "j string")
    assert r.select(chat_format.field_paths(F.parse_json("j"))).first()[0].split("\n") == ["a.b[].c", "a.b[].d.e", "f[]", "we:ird"]


def test_media_round_trip(spark, odd_docs, no_docs):
    path = shared.new_path(spark, "test-shards")
    media.write_shards(odd_docs.repartition(2), path, shard_bytes=50_000)
    rows = media.read_rows(spark, path, payload=True).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), hashlib.sha256(media.payload_of((r.text or "").encode())).hexdigest(), zlib.crc32(media.payload_of((r.text or "").encode())[-64:])) for r in odd_docs.collect())
    assert sorted((str(r.key), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert all(r.digest == r.media_sha256 and r.width == 64 and r.width * r.height == r.payload_bytes and r.bits == 8 for r in rows)
    for shard in {r.shard for r in rows}:
        with tarfile.open(urlparse(shard).path) as tar:
            for r in rows:
                if r.shard == shard:
                    image = tar.extractfile(f"{r.digest}.png").read()
                    assert len(image) == r.length and hashlib.sha256(image).hexdigest() == r.media_sha256
    empty = shared.new_path(spark, "test-empty")
    media.write_shards(no_docs, empty)
    assert media.read_rows(spark, empty, payload=True).count() == 0


def test_media_query_equals_plain_computation(spark, small):
    texts = {r.doc_id: (r.text or "").encode() for r in shared.table(spark, small, "documents").select("doc_id", "text").collect()}
    rows = media.op3_media_columns(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        body = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64)
        body = body or bytes(64)
        lines = b"".join(b"\0" + body[i : i + 64] for i in range(0, len(body), 64))
        n = [body.count(k) for k in range(256)]
        mean = sum(k * c for k, c in enumerate(n)) / len(body)
        deviation = math.sqrt(sum(c * (k - mean) ** 2 for k, c in enumerate(n)) / len(body))
        entropy = -sum(c / len(body) * math.log2(c / len(body)) for c in n if c)
        got = dict(part.split("=") for part in r.feature.split(";"))
        assert all(abs(float(got[k]) - v) < 1e-4 for k, v in (("mean", mean), ("deviation", deviation), ("entropy", entropy), ("blank", (n[32] + n[0]) / len(body))))
        assert int(got["levels"]) == sum(map(bool, n))
        assert r.media_bytes == 57 + len(zlib.compress(lines, 1)) and (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(body))
        assert r.payload_sha256 == hashlib.sha256(body).hexdigest() and r.tail_crc32 == zlib.crc32(body[-64:])


def test_ranges_are_the_content(tmp_path):
    (tmp_path / "a b.tar").write_bytes(bytes(range(256)))
    for path, content in ((f"file://{tmp_path}/a%20b.tar", None), ("x", bytes(range(256)))):
        r = media.Ranges(path, content)
        assert r.read(10, 5) == bytes(range(10, 15)) and r.read(250, 100) == bytes(range(250, 256))
        r.close()


def test_damaged_image_is_noticed():
    image = bytearray(media.to_png(media.payload_of(b"some text" * 20)))
    image[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(image))


def test_long_records_are_read_like_short_ones(spark):
    odd = ["<|im_end|>", "", None, '{"json": [1]}', 'a "quoted": "b", \\ and \\"', "\\", "line\nline\ttab", "é😀\u0001"]
    roles = [("user", "assistant"), ("system", "user", "assistant"), ("assistant", "user", "tool", 'say "x": ')]
    rows = [(c, t, r, odd[(c * 5 + t) % len(odd)], None, None) for c in range(48) for t, r in enumerate(roles[c % 9 // 3])]
    records = chat_format.records_of(spark.createDataFrame(rows, CHATS)).withColumnRenamed("conv_id", "id")
    short, long = ({r.id: r for r in chat_format.format_records(records, long_bytes=n).collect()} for n in (chat_format.LONG, 1))
    assert short == long and {r.layout for r in long.values()} == {x.name for x in chat_format.LAYOUTS}


def test_turns_beyond_the_parser_limit_keep_their_text(spark):
    """21 million characters in one turn: once the whole conversation came out empty."""
    turns = spark.createDataFrame([(c, t, r) for c in (0, 4, 5) for t, r in enumerate(("user", "assistant", "user")[: 2 + c // 4])], "conv_id long, turn long, role string")
    turns = turns.withColumn("text", F.when(F.col("turn") == 0, F.repeat(F.lit('a"\n'), 7_000_000)).otherwise("short"))
    done = chat_format.known_only(chat_format.format_records(chat_format.records_of(turns).withColumnRenamed("conv_id", "id"), key="id"))
    want = hashlib.sha256()
    for part in ("user\n", 'a"\n' * 7_000_000, "\nassistant\nshort\n"):
        want.update(part.encode())
    got = {r.conv_id: r for r in chat_format.digests(done.withColumnRenamed("id", "conv_id")).collect()}
    assert [got[c].n_turns for c in (0, 4, 5)] == [2, 3, 3] and all(r.loss_chars == 5 and r.formatted_chars > 21_000_000 for r in got.values())
    assert got[0].turns_sha256 == want.hexdigest()


def test_records_without_a_layout_raise_in_the_query(spark):
    bad = spark.createDataFrame([(1, "not json")], "id long, record string")
    with pytest.raises(Exception, match="no known layout"):
        chat_format.known_only(chat_format.format_records(bad)).collect()


def test_a_conversation_of_very_many_turns_takes_linear_time(spark):
    import time

    n = 200_000
    said = F.concat(F.lit("some words "), F.col("id").cast("string"))
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    began = time.time()
    done = chat_format.known_only(chat_format.format_records(chat_format.records_of(turns).withColumnRenamed("conv_id", "id"), key="id"))
    row = chat_format.digests(done.withColumnRenamed("id", "conv_id")).first()
    loss = "".join(f"some words {k}" for k in range(1, n, 2))
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert time.time() - began < 90
