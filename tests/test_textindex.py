"""The text index: stems, resumed builds, and ranking that equals plain BM25."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import retrieval as rt
from loomtrace.operators import textindex as ti

#: Words and their stems by Porter's published rules.
STEMS = dict(zip(
    "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators playing be a apologi".split(),
    "caress poni ti caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration valenc hesit digit conform radic differ vile analog vietnam predic oper feudal decis hope callous formal sensit sensibl triplic form formal electr electr hope good reviv allow infer airlin gyroscop adjust defens irrit replac adjust depend adopt homolog commun activ angular homolog effect bowdler probat rate ceas control roll gener oscil plai be a apolog".split(),
    strict=True,
))


def test_stems(spark):
    rows = spark.createDataFrame([(w, w) for w in STEMS] + [("x" * 70 + "ing", "x" * 70 + "ing")], "word string, stem string")
    got = dict(rows.select("word", ti.stem("stem")).collect())
    assert got == STEMS | {"x" * 70 + "ing": "x" * 70 + "ing"}


def test_stems_in_sql():
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE v AS SELECT unnest(?) AS term", [list(STEMS)])
    assert dict(c.execute(f"WITH {ti.stem_sql('v', 'st')} SELECT term, stem FROM st").fetchall()) == STEMS


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{k}" for k in range(300)] + list(STEMS) + ["Größe", "CAFÉ"]
    weight = [1000 / (k + 1) for k in range(len(words))]
    return [(i, None if i % 41 == 7 else " ".join(rng.choices(words, weight, k=rng.randint(0, 60)))) for i in range(n)]


def write_source(folder, rows, files):
    folder.mkdir(exist_ok=True)
    for k in range(files):
        lines = [json.dumps({"id": i, "contents": t}) for i, t in rows[k::files]]
        (folder / f"part-{k}.jsonl").write_text("\n".join(lines) + "\n")


def held(spark, index):
    return sorted(tuple(r) for r in spark.read.parquet(f"{index}/postings").select("doc", "dl", "term", "tf").collect())


def test_interrupted_build_equals_a_whole_one(spark, tmp_path):
    rows = texts(400)
    write_source(tmp_path / "source", rows, 6)
    source, schema = str(tmp_path / "source"), "id long, contents string"
    ti.ingest(spark, source, f"{tmp_path}/whole", schema=schema, files=2)

    def stop(number):
        if number == 1:
            raise KeyError("interrupted")

    with pytest.raises(Exception, match="interrupted"):
        ti.ingest(spark, source, f"{tmp_path}/parts", schema=schema, files=2, on_batch=stop)
    assert 0 < len(held(spark, f"{tmp_path}/parts")) < len(held(spark, f"{tmp_path}/whole"))
    for _ in range(2):
        ti.ingest(spark, source, f"{tmp_path}/parts", schema=schema, files=2)
        assert held(spark, f"{tmp_path}/parts") == held(spark, f"{tmp_path}/whole")

    # More files are more documents; a file that has changed raises.
    (tmp_path / "source" / "more.jsonl").write_text(json.dumps({"id": 9999, "contents": "unheard of wordings"}) + "\n")
    ti.ingest(spark, source, f"{tmp_path}/parts", schema=schema, files=2)
    assert [r[2] for r in held(spark, f"{tmp_path}/parts") if r[0] == 9999] == ["of", "unheard", "word"]
    ti.optimise(spark, f"{tmp_path}/parts")
    index = ti.opened(spark, f"{tmp_path}/parts")
    assert index.rows == 401
    asked = spark.createDataFrame([(1, "an unheard wording")], "query_id long, query string")
    assert [r.doc for r in ti.rank(index, asked, 3).collect()] == [9999]
    with (tmp_path / "source" / "part-0.jsonl").open("a") as f:
        f.write(json.dumps({"id": 1, "contents": "late"}) + "\n")
    with pytest.raises(Exception, match="source size changed"):
        ti.ingest(spark, source, f"{tmp_path}/parts", schema=schema, files=2)


@pytest.mark.parametrize("k, steps, first", [(1, 64, 1 << 16), (7, 64, 1 << 16), (7, 4, 50), (500, 64, 1 << 16)])
def test_ranking_equals_all_postings(spark, monkeypatch, k, steps, first):
    monkeypatch.setattr(ti, "STEPS", steps)
    monkeypatch.setattr(ti, "FIRST_ROWS", first)
    rows = texts(300, seed=k)
    docs = spark.createDataFrame(rows + rows[:40] + [(None, "wa0 wb1 hopping"), (5, "wa0 ponies")], "doc_id long, text string")
    index = ti.index_of(docs)
    asked = spark.createDataFrame([(1, "wa0 wb1 wc2"), (2, "wz25 pony ties WA0"), (3, "Größe cafe"), (4, "nothing-here"), (5, None), (6, " ".join(f"w{chr(97 + i % 26)}{i}" for i in range(0, 300, 7)))], "query_id long, query string")
    order = lambda df: sorted((r.query_id, r["rank"], r.doc is None, r.doc or 0, r.score) for r in df.collect())
    got = order(ti.rank(index, asked, k))
    assert got == order(ti.plain_rank(index, asked, k))
    assert {r[0] for r in got} == {1, 2, 3, 6} and max(r[1] for r in got) <= k


def test_ranking_reads_less_than_all_postings(spark, monkeypatch):
    """A rare word beside frequent ones: the frequent ones are read for the rows that the rare one finds."""
    rows = [(i, "the of and " + ("rare gem" if i % 500 == 3 else f"other{i % 7}")) for i in range(3000)]
    index = ti.index_of(spark.createDataFrame(rows, "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "the rare gem of and")], "query_id long, query string")
    kept = {}
    real = ti.staged
    monkeypatch.setattr(ti, "staged", lambda df, label: kept.setdefault(label, real(df, label)))
    assert [r.doc for r in ti.rank(index, asked, 3).orderBy("rank").collect()] == [3, 503, 1003]
    assert {r.term for r in kept["wanted"].collect()} <= {"rare", "gem"} and kept["candidates"].count() <= 6


def test_words_without_stems_rank_as_plain_bm25(spark):
    docs = spark.createDataFrame([(i, " ".join(w for w in (t or "").split() if w[-1].isdigit())) for i, t in texts(200, seed=9)], "doc_id long, text string").where("text <> ''")
    asked = spark.createDataFrame([(1, "wa0 wf5"), (2, "wb1 wc2 wz25")], "query_id long, query string")
    order = lambda df: sorted((r.query_id, r["rank"], r.doc, round(r.score, 5)) for r in df.collect())
    assert order(ti.rank(ti.index_of(docs), asked, 10)) == order(rt.bm25(docs, asked, 10))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    assert ti.rank(ti.index_of(none), asked, 5).count() == 0
    some = ti.index_of(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert ti.rank(some, asked.limit(0), 5).count() == 0
