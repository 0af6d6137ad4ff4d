"""A stemmed full-text index that is built in resumable batches, and BM25 ranking that skips what cannot be among the best.

An index is a folder: ``postings`` by batch, ``sources`` (which file of which size went into which batch), the stream's own
``checkpoint``, and, once :func:`optimise` has run, ``impacts``: postings with their impact (the part of BM25 that no query changes) and the
block of impacts that they belong to. A block is a step of the impact scale, so no term's postings are sorted or
numbered as a group, however frequent the term.

Ranking (:func:`rank`) is exact. The blocks with a term's greatest impacts give each query some rows, whose whole scores show what its k-th
best row reaches at least. Terms whose greatest parts together stay below that cannot bring in a row by themselves; of the others only
blocks are read that can still reach it together with the rest. What may then be among the best is scored in full.

Defined cases: null text has no terms; rows that repeat an id are rows of their own (:func:`retrieval.distinct_first` keeps the first); null ids
are ids; a query without known terms finds nothing; ties go to the smaller id, then the smaller row number; fewer rows than
asked for give fewer. Scores are sums of whole billionths, the same in any order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..staging import new_path, staged
from .retrieval import bm25
from .validation import require_empty

#: Letters with marks of Western European languages, and what an index without marks holds for them (fixed values).
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN, QUERY_TOKEN = r"[\p{L}\p{N}]+", "[a-z0-9]+"
K1, B = 1.2, 0.75
#: Steps of the impact scale, which ends at K1 + 1; rows of one term that the first look reads at most.
STEPS, FIRST_ROWS = 64, 1 << 11
#: Rows whose whole scores the first look works out, beside two for each of the k.
LOOK = 32
#: Bounds are doubles and parts are rounded; a bound this much below a score counts as reaching it.
SLACK = 1e-6

# ---- stemming: Porter's rules (fixed values)

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: What stands before a suffix: some vowel; one, or two, groups of vowels and consonants; such that e is put back.
HAS_VOWEL, ONE, TWO = f"^({_C})?[aeiouy]", f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
TWO_AND_ST, TWO_WITH_L = f"^({_C})?{_V}{_C}{_V}.*[st]$", f"^({_C})?{_V}{_C}[aeiouy]"
#: Steps of (suffix, replacement, condition on what stands before it, what must not stand there). Of a step the first suffix that
#: a word ends with decides. ``~`` marks that something was cut, and the next step tidies up.
STEM: tuple[tuple[tuple[str, str, str, str], ...], ...] = (
    (("sses", "ss", "", ""), ("ies", "i", "", ""), ("ss", "ss", "", ""), ("s", "", "", "")),
    (("eed", "ee", ONE, ""), ("ed", "~", HAS_VOWEL, ""), ("ing", "~", HAS_VOWEL, "")),
    (("at~", "ate", "", ""), ("bl~", "ble", "", ""), ("iz~", "ize", "", ""), *((x + x + "~", x, "", "") for x in "bcdfghjkmnpqrtvwx"), ("~", "e", SHORT, "")),
    (("~", "", "", ""),),
    (("y", "i", HAS_VOWEL, ""),),
    tuple((s, r, ONE, "") for s, r in (
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
        ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
    )),
    tuple((s, r, ONE, "") for s, r in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))),
    (*((s, "", TWO, "") for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")), ("ion", "", TWO_AND_ST, "")),
    (("e", "", ONE, SHORT),),
    (("ll", "l", TWO_WITH_L, ""),),
)
#: Words of other lengths stay as they are; stems that a worker remembers.
STEMMED, REMEMBERED = (3, 64), 1 << 17


class Stems(dict):
    """Stems of words by the rule table; as many words as ``REMEMBERED`` are remembered."""

    def __init__(self) -> None:
        super().__init__()
        rule = lambda suffix, new, condition, unless: (suffix, new, re.compile(condition).match if condition else None, re.compile(unless).match if unless else None)
        self.steps = [[rule(*r) for r in step] for step in STEM]

    def __missing__(self, word: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        stem = word
        for step in self.steps:
            # A mark is tidied up whatever the length that is left.
            if not STEMMED[0] <= len(stem) <= STEMMED[1] and not stem.endswith("~"):
                continue
            for suffix, new, condition, unless in step:
                if stem.endswith(suffix):
                    before = stem[: len(stem) - len(suffix)]
                    if (condition is None or condition(before)) and not (unless and unless(before)):
                        stem = before + new
                    break
        self[word] = stem
        return stem


_stems = Stems()


def stem_of(word: str) -> str:
    """The stem of a word, from what this worker remembers."""
    return _stems[word]


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Stems of single words."""
    return words.map(stem_of, na_action="ignore")


def stem_sql(source: str, result: str) -> str:
    """Common tables of DuckDB that turn ``source`` (term) into ``result`` (term, stem), by the same rules."""
    tables = [f"{result}_0 AS (SELECT DISTINCT term, term AS stem FROM {source})"]
    for k, step in enumerate(STEM):
        cases = []
        for suffix, new, condition, unless in step:
            before = f"left(stem, length(stem) - {len(suffix)})"
            ok = " AND ".join([f"regexp_matches({before}, '{condition}')"] * bool(condition) + [f"NOT regexp_matches({before}, '{unless}')"] * bool(unless)) or "true"
            cases.append(f"WHEN ends_with(stem, '{suffix}') THEN CASE WHEN {ok} THEN {before} || '{new}' ELSE stem END")
        name = result if k == len(STEM) - 1 else f"{result}_{k + 1}"
        fit = f"length(stem) BETWEEN {STEMMED[0]} AND {STEMMED[1]} OR ends_with(stem, '~')"
        tables.append(f"{name} AS (SELECT term, CASE WHEN NOT ({fit}) THEN stem {' '.join(cases)} ELSE stem END AS stem FROM {result}_{k})")
    return ",\n".join(tables)


def query_terms(queries: DataFrame, *, query: str = "query") -> DataFrame:
    """(query_id, term): the distinct stems of a query's ASCII letters and digits."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(query)), F.lit(QUERY_TOKEN), F.lit(0)))).alias("term"))
    return words.select("query_id", stem("term").alias("term")).distinct()


def postings_of(docs: DataFrame, *, key: str, text: str, batch: int = 0) -> DataFrame:
    """(row, doc, dl, term, tf) of every row with any term: runs of letters and digits in lower case, without marks, stemmed. ``row`` numbers rows:
    20 bits of batch, 15 of partition, 28 within it. A text's terms are counted where it is read, so nothing is shuffled."""
    at = F.monotonically_increasing_id()
    part, within = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
    row = F.when((part < 1 << 15) & (within < 1 << 28), F.lit(batch << 43) + F.shiftleft(part, 28) + within).otherwise(F.raise_error(F.lit("too many rows in one batch")).cast("long"))
    rows = docs.select(row.alias("row"), F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    plain = str.maketrans(MARKED, PLAIN)
    split = re.compile(r"[^\W_]+").findall  # what TOKEN says

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                owner, lengths, terms, times = [], [], [], []
                for k, t in enumerate(b.column("text").to_pylist()):
                    words = Counter(split((t or "").lower().translate(plain)))
                    found: dict[str, int] = {}
                    for w, n in words.items():
                        s = stem_of(w)
                        found[s] = found.get(s, 0) + n
                    owner += [k] * len(found)
                    lengths += [sum(found.values())] * len(found)
                    terms += found.keys()
                    times += found.values()
                of = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("row").take(of), b.column("doc").take(of), pa.array(lengths, pa.int64()), pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["row", "doc", "dl", "term", "tf"])

    return rows.mapInArrow(count, f"row long, doc {kind}, dl long, term string, tf long")


# ---- building


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def check_sources(spark: SparkSession, source: str, index: str) -> None:
    """Raise if a file that the index holds has another size now, or is gone."""
    try:
        known = spark.read.parquet(f"{index}/sources").select("path", "size").distinct()
    except Exception as e:  # noqa: BLE001 - the index has no batch yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return
    there = spark.read.format("binaryFile").load(source).select(_plain_path(F.col("path")).alias("path"), "length")
    changed = known.join(there, "path", "left").where("length is null or length <> size")
    require_empty(changed, "source size changed after indexing started")


def ingest(spark: SparkSession, source: str, index: str, *, schema: str, form: str = "json", key: str = "id", text: str = "contents", files: int = 64, on_batch: Callable[[int], None] = lambda n: None) -> None:
    """Index what a folder of files holds beyond what the index has, ``files`` of them a batch.

    A batch writes its own folder, so one that was interrupted is written again by the next call and leaves nothing behind twice. ``on_batch`` is called
    with a batch's number before it is written."""
    check_sources(spark, source, index)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(source)
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), _plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_size").alias("size"))

    def write(batch: DataFrame, number: int) -> None:
        on_batch(number)
        postings_of(batch, key="key", text="text", batch=number).write.mode("overwrite").parquet(f"{index}/postings/batch={number}")
        batch.groupBy("path", "size").agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{index}/sources/batch={number}")

    stream = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{index}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()


@dataclass(frozen=True)
class TextIndex:
    """impacts (row, doc, term, block, impact); blocks (term, block, rows, most); the number of rows."""

    impacts: DataFrame
    blocks: DataFrame
    rows: int


def _weighed(postings: DataFrame) -> DataFrame:
    """Postings with impacts and blocks; the mean length is that of rows with any term."""
    lengths = postings.groupBy("row").agg(F.first("dl").alias("dl"))
    mean = lengths.agg(F.avg("dl")).first()[0] or 1.0
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    step = F.least(F.floor(F.col("impact") * STEPS / (K1 + 1)), F.lit(STEPS - 1)).cast("int")
    return postings.select("row", "doc", "term", impact.alias("impact")).withColumn("block", step)


def _blocks(impacts: DataFrame) -> DataFrame:
    return impacts.groupBy("term", "block").agg(F.count("*").alias("rows"), F.max("impact").alias("most"))


def optimise(spark: SparkSession, index: str) -> None:
    """Write the impacts of all batches, near each other by term. May be repeated at any time, as after further batches."""
    rows = spark.read.parquet(f"{index}/sources").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    impacts = _weighed(spark.read.parquet(f"{index}/postings"))
    impacts.repartitionByRange("term", "block", "row").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{index}/impacts")
    _blocks(spark.read.parquet(f"{index}/impacts")).withColumn("total", F.lit(rows)).write.mode("overwrite").parquet(f"{index}/blocks")


def opened(spark: SparkSession, index: str) -> TextIndex:
    """An optimised index."""
    blocks = spark.read.parquet(f"{index}/blocks")
    first = blocks.select("total").first()
    return TextIndex(spark.read.parquet(f"{index}/impacts"), blocks.drop("total"), first[0] if first else 0)


def index_of(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> TextIndex:
    """An index of a table, staged for as long as the process lasts. Impacts are worked out as the postings are read."""
    impacts = _weighed(staged(postings_of(docs, key=key, text=text), "postings"))
    return TextIndex(impacts, staged(_blocks(impacts), "blocks"), docs.count())


# ---- ranking


def _idf(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, idf, bound) of the queries' known terms; a term's parts are at most ``bound``."""
    terms = index.blocks.groupBy("term").agg(F.sum("rows").alias("df"), F.max("most").alias("most"))
    idf = F.greatest(F.log((F.lit(index.rows) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return query_terms(queries).join(terms, "term").select("query_id", "term", idf.alias("idf"), (idf * F.col("most")).alias("bound"))


def _part() -> Column:
    """A term's part of a score in billionths: whole numbers have one sum in any order."""
    return F.round(F.col("idf") * F.col("impact") * 1e9).cast("long")


def _best(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, rank, score) from sums in billionths, which are rounded to millionths."""
    whole = scores.select("query_id", "row", "doc", F.expr("(sum + 500) div 1000").alias("micro"))
    w = Window.partitionBy("query_id").orderBy(F.desc("micro"), "doc", "row")
    return whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "doc", "rank", (F.col("micro") / 1e6).alias("score"))


def rank(index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, rank, score): the k best rows of every query by BM25 over its distinct stems; idf = ln((N - n + 0.5) / (n + 0.5)),
    at least 1e-6; parts are rounded to nine digits, scores to six."""
    asked = staged(_idf(index, queries), "asked")
    sums = lambda wanted: wanted.join(index.impacts.select("row", "term", "block", "impact"), ["term", "block"]).groupBy("query_id", "row").agg(F.sum(_part()).alias("sum"))

    def complete(rows: DataFrame) -> DataFrame:
        """The whole scores of (query_id, row): all terms of the query, from the postings of these rows alone."""
        near = index.impacts.select("row", "doc", "term", "impact").join(asked.select("term").distinct(), "term", "left_semi").join(rows.select("row").distinct(), "row", "left_semi")
        return near.join(rows.join(asked, "query_id").select("query_id", "row", "term", "idf"), ["row", "term"]).groupBy("query_id", "row", "doc").agg(F.sum(_part()).alias("sum"))

    # A first look: the topmost blocks of each term that hold k rows, where they are few; the whole scores of what is best there.
    above = F.sum("rows").over(Window.partitionBy("term").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = index.blocks.join(asked.select("term").distinct(), "term", "left_semi").withColumn("above", above)
    top = top.where((F.col("above") - F.col("rows") < k) & (F.col("above") <= FIRST_ROWS)).select("term", "block")
    place = lambda: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sum"), "row"))
    seen = staged(sums(asked.join(top, "term")).withColumn("place", place()).where(F.col("place") <= 2 * k + LOOK).select("query_id", "row"), "seen")
    least = complete(seen).withColumn("place", place()).where(F.col("place") == k).select("query_id", (F.col("sum") / 1e9).alias("least"))
    known = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)

    # Terms in the order of their bounds: those that together stay below the least score are skipped.
    by = Window.partitionBy("query_id")
    below = F.sum("bound").over(by.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = known.withColumn("skipped", below < F.col("least")).withColumn("all", F.sum("bound").over(by))
    known = staged(known.withColumn("rest", F.coalesce(F.sum(F.when(F.col("skipped"), F.col("bound"))).over(by), F.lit(0.0))), "known")
    reaching = known.where("not skipped").join(index.blocks, "term").where(F.col("idf") * F.col("most") + F.col("all") - F.col("bound") >= F.col("least"))
    wanted = staged(reaching.select("query_id", "term", "block", "idf"), "wanted")
    limits = known.groupBy("query_id").agg(F.first("least").alias("least"), F.first("rest").alias("rest"))
    found = sums(wanted).join(limits, "query_id").where(F.col("sum") / 1e9 + F.col("rest") >= F.col("least")).select("query_id", "row")
    return _best(complete(staged(found, "candidates")), k)


#: Distinct terms of queries, and cells of terms by queries, that every task holds at most; more of them are ranked by :func:`rank`.
HELD_TERMS, HELD_CELLS = 1 << 17, 1 << 22
#: Rows of one product.
SLICE_ROWS = 256


def _hits(docs: DataFrame, number: Broadcast, *, key: str, text: str, stems: bool) -> DataFrame:
    """(row, doc, dl, at, tf) of every row: how often it has each of the queries' terms, by their numbers."""
    kind = docs.schema[key].dataType.simpleString()
    low = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    plain = str.maketrans(MARKED, PLAIN)
    split = re.compile(r"[^\W_]+" if stems else QUERY_TOKEN).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                lengths, terms, times = [], [], []
                if len(known) > REMEMBERED:
                    known.clear()
                for t in b.column("text").to_pylist():
                    words = split(t.lower().translate(plain) if stems else t)
                    found: dict[int, int] = {}
                    for w, n in Counter(words).items():
                        k = known.get(w)
                        if k is None:
                            k = known[w] = number.value.get(stem_of(w) if stems else w, -1)
                        if k >= 0:
                            found[k] = found.get(k, 0) + n
                    lengths.append(len(words))
                    terms.append(list(found))
                    times.append(list(found.values()))
                lists = [pa.array(x, pa.list_(pa.int32())) for x in (terms, times)]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc"), pa.array(lengths, pa.int64()), *lists], ["row", "doc", "dl", "at", "tf"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), (F.col(text).cast("string") if stems else low).alias("text"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return rows.mapInArrow(count, f"row long, doc {kind}, dl long, at array<int>, tf array<int>")


def ranked(docs: DataFrame, queries: DataFrame, k: int, *, key: str = "doc_id", text: str = "text", stems: bool = True) -> DataFrame:
    """What :func:`rank` returns for an index of ``docs``, for queries that fit a task: every row is scored where it lies, and a task
    hands on the k best rows of each query alone. Long queries name most rows, so what :func:`rank` shuffles for them outgrows the
    texts; here no posting is shuffled. Without ``stems`` terms are runs of ASCII letters and digits, as in :func:`retrieval.bm25`."""
    spark = docs.sparkSession
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("query")), F.lit(QUERY_TOKEN), F.lit(0)))
    asked = staged(query_terms(queries) if stems else queries.select("query_id", F.explode(words).alias("term")).distinct(), "asked")
    pairs = asked.limit(HELD_TERMS + 1).collect()
    ids = sorted({p[0] for p in pairs}, key=lambda x: (x is not None, x))
    number = {t: i for i, t in enumerate(sorted({p[1] for p in pairs}))}
    # Without stems rows of one id are one text, and null ids none.
    odd = not stems and not docs.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).isEmpty()
    if odd or not pairs or len(pairs) > HELD_TERMS or len(ids) * len(number) > HELD_CELLS:
        return rank(index_of(docs, key=key, text=text), queries, k) if stems else bm25(docs, queries, k, key=key, text=text)
    hits = staged(_hits(docs, spark.sparkContext.broadcast(number), key=key, text=text, stems=stems), "hits")
    total, mean = hits.agg(F.count("*"), F.avg(F.when(F.col("dl") > 0, F.col("dl")))).first()
    df = np.zeros(len(number))
    for i, n in hits.select(F.explode("at").alias("i")).groupBy("i").agg(F.count("*")).collect():  # a row a term of the queries
        df[i] = n
    place = {q: i for i, q in enumerate(ids)}
    wanted = np.zeros((len(number), len(ids)))
    for q, t in pairs:
        wanted[number[t], place[q]] = 1.0
    held = spark.sparkContext.broadcast((np.maximum(np.log((total - df + 0.5) / (df + 0.5)), 1e-6), wanted))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, wanted = held.value
        best: list[list[tuple]] = [[] for _ in range(wanted.shape[1])]
        last: list[tuple | None] = [None] * len(best)  # the k-th best of each query once there are so many
        least = np.ones(len(best))  # its millionths
        kind = None

        def cut(q: int) -> None:
            best[q].sort()
            del best[q][k:]
            if len(best[q]) == k:
                last[q], least[q] = best[q][-1], -best[q][-1][0]

        for whole in batches:
            kind = whole.column("doc").type
            for start in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(start, SLICE_ROWS)
                at, tf = b.column("at").flatten().to_numpy(zero_copy_only=False), b.column("tf").flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("at")).to_numpy(zero_copy_only=False))
                dl = b.column("dl").to_numpy()[owner]
                # Parts are whole billionths, whose sums a double holds exactly.
                parts, there = np.zeros((b.num_rows, len(idf))), np.zeros((b.num_rows, len(idf)), np.float32)
                there[owner, at] = 1.0
                if stems:
                    parts[owner, at] = np.floor(idf[at] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))) * 1e9 + 0.5)
                else:
                    parts[owner, at] = np.floor(idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)) * 1e9 + 0.5)
                micro = np.floor((parts @ wanted + 500) / 1000)
                touched = there @ wanted.astype(np.float32) > 0
                docs_, rows_ = b.column("doc").to_pylist(), b.column("row").to_pylist()
                for i, q in zip(*(x.tolist() for x in np.nonzero(touched & ((micro >= least) | (least <= 1))))):
                    one = (-int(micro[i, q]), docs_[i] is not None, docs_[i], rows_[i]) if docs_[i] is not None else (-int(micro[i, q]), False, 0, rows_[i])
                    if last[q] is None or one < last[q]:
                        best[q].append(one)
                        if len(best[q]) >= 2 * k + 64:
                            cut(q)
        for q in range(len(best)):
            cut(q)
            if best[q]:
                scores, known, doc, row = zip(*best[q])
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(doc), pa.int32()), pa.array(row, pa.int64()), pa.array([d if t else None for d, t in zip(doc, known)], kind), pa.array([-1000 * s for s in scores], pa.int64())], ["q", "row", "doc", "sum"])

    kind = docs.schema[key].dataType.simpleString()
    found = hits.where(F.size("at") > 0).mapInArrow(score, f"q int, row long, doc {kind}, sum long")
    names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("q", IntegerType()), StructField("query_id", queries.schema["query_id"].dataType)]))
    return _best(found.join(F.broadcast(names), "q"), k)  # a name a query


def plain_rank(index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """What :func:`rank` returns, from all postings of all terms: for comparison."""
    hits = _idf(index, queries).join(index.impacts, "term")
    return _best(hits.groupBy("query_id", "row", "doc").agg(F.sum(_part()).alias("sum")), k)


def scratch_index(spark: SparkSession) -> str:
    """A new folder for an index in the shared folder, removed when the process ends."""
    return new_path(spark, "index")
