import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomtrace.llm import packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"ab 's'll're  \t\n\r!?.12ßéñ中文   \x85\x1c\x1f'Don ½²ⅧⅧ", "<|endoftext|>", " the", "'ve", "''", "😀", "́", "Σ", "İ"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_counts_and_every_prefix_equal_the_library():
    library, counter = Tokenizer.from_file(BYTES), token_counts.PrefixCounter(BYTES)
    some = texts(700, 3)
    for t, table in zip(some, counter.tables(some)):
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert table.total == want[-1]
        assert counter.prefix_counts(t) == want
        assert [table.at(k) for k in range(len(t) + 1)] == want
        assert table.stored(3) == want[3::3]


def test_stored_counts_of_long_texts_equal_the_library(spark):
    library, counter = Tokenizer.from_file(BYTES), token_counts.PrefixCounter(BYTES)
    rng = random.Random(11)
    some = [" ".join(rng.choice(["the", "word,", "x\ny", "", "unbelievably", "z" * 90, "don't", "12.5", "\n", "ß" * 5]) for _ in range(900)) for _ in range(5)] + ["y" * 3000]
    for t, table in zip(some, counter.tables(some)):
        assert table.stored() == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(1024, len(t) + 1, 1024)]
    begun = time.time()
    for t in ("ab" * 150_000, " " * 200_000, "a" * 100_000 + " b"):
        table = next(counter.tables([t]))
        assert table.total == len(library.encode(t, add_special_tokens=False).ids) and table.stored()[-1] <= table.total and table.cut(1024) < len(t)
    assert time.time() - begun < 60
    assert not [w for w in counter._totals if len(w) > token_counts.LONGEST_CHUNK] or counter.long


def test_cut_is_within_budget():
    counter = token_counts.PrefixCounter(BYTES)
    t = "The quick brown fox jumps over the lazy dog and unbelievably keeps running onwards. " * 3
    counts, table = counter.prefix_counts(t), next(counter.tables([t]))
    for budget in (0, 1, 5, 17, 1000):
        cut = table.cut(budget)
        assert counts[cut] <= budget
        assert cut == len(t) or max(counts[cut + 1 : cut + 20], default=budget + 1) > budget
        kept = token_counts.kept_within(table.stored(16), counts[-1], len(t), budget, 16)
        assert counts[kept] <= budget and (kept == len(t) or counts[min(kept + 16, len(t))] > budget)


def test_token_counts_on_odd_rows(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(BYTES)
    got = token_counts.token_counts(odd_docs, BYTES).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    text = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert all(r.prefix_tokens == [len(library.encode(text[r.doc_id][:k], add_special_tokens=False).ids) for k in range(1024, len(text[r.doc_id]) + 1, 1024)] for r in got if r.doc_id != 8)
    assert token_counts.token_counts(no_docs, BYTES).count() == 0


def test_word_ids_equal_the_library():
    library, own = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    some = texts(4000, 9)
    assert own.encode(some) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_pack_odd_rows(spark, odd_docs, no_docs):
    pieces = packing.pack(odd_docs.repartition(3), WORDS, window=256, open_windows=2, min_cut=8).toPandas()
    library = Tokenizer.from_file(WORDS)
    for r in odd_docs.where("doc_id is not null and doc_id <> 4").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = pieces[pieces.doc_id == r.doc_id].sort_values("start")
        assert mine["length"].sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        at = 0
        for p in mine.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
    for _, w in pieces.groupby("sequence_id"):
        w = w.sort_values("offset")
        assert w["length"].sum() <= 256 and w.offset.tolist() == [0, *w["length"].cumsum().tolist()[:-1]]
    assert (pieces.doc_id == 4).sum() == 2 and pieces[pieces.doc_id == 4].row.nunique() == 2
    assert pieces.row.nunique() == odd_docs.count()
    assert packing.pack(no_docs, WORDS).count() == 0


def test_windows_are_well_filled(spark, small):
    p = packing.op7_packing(spark, small).toPandas()
    assert p["length"].sum() / (2048 * p.sequence_id.nunique()) > 0.95


@pytest.mark.parametrize("length", [1, 5, 8])
def test_best_fit_prefers_the_fullest_that_has_room(length):
    w = packing.OpenWindows(8, 3)
    for n in (7, 6, 5):
        assert w.place(n, n)
    assert w.place(length, length) == (length <= 3)
    assert w.fullest() == (0 if length == 1 else 1)


def test_large_ids_beside_null_ones_stay(spark):
    rows = [(2**53 + 1, "some words here"), (None, "no id at all"), (2**53 + 3, "w " * 5000), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(str(r[0]) for r in rows)
    assert sorted(str(r.doc_id) for r in token_counts.token_counts(docs, BYTES).collect()) == want
    pieces = packing.pack(docs, WORDS).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == want
    assert {r.doc_id for r in pieces if r.start > 0} == {2**53 + 3}
    named = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert sorted(str(r.doc_id) for r in packing.pack(named, WORDS).collect() if r.start == 0) == want
