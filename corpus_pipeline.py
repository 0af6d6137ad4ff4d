"""A training-corpus pipeline of five operators: toxicity, near duplicates, repeated substrings, mixing, packing.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before it kept, read from Parquet, and
returns the columns of documents (the last one the placed pieces). Rows are told apart by 128 bits of SHA-256 over all columns
of documents; rows alike in all of them are copies of one another, and stages that choose rows count them.

Defined cases, for all stages: null text counts as empty; null and repeated ids do no harm, as ids identify nothing; whole
texts are read, however long; ties go to the smaller id, then the smaller digest; an empty table stays empty; columns beyond
those of documents are left out, whatever their names. A text that loses repeated bytes keeps its row, even
if nothing is left of it; bytes of a character that a cut has split go with the cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import mixing, packing, shared, simhash_dedup, suffix_dedup, toxicity

#: Fixed columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Words of a shingle in the near-copies stage. A changed word changes as many shingles, so short ones bring fingerprints of near
#: copies closer at the same radius, which sets the cost: of pairs that share 0.8 or more of their five-word shingles, two words
#: link over twice as many as the four of operator 10's own query.
SHINGLE = 2

#: Identities that are broadcast at most (16 bytes each); more of them are joined by a shuffle.
FEW = 1_000_000


def _small(uids: DataFrame) -> DataFrame:
    """Staged identities, broadcast if they are few: a join that is planned as a shuffle has shuffled all texts before adaptive
    execution sees how few they are."""
    uids = shared.staged(uids, "uids")
    return F.broadcast(uids) if uids.limit(FEW + 1).count() <= FEW else uids


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, shared.digest(*COLUMNS).alias("uid"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger does not call toxic. It learns from the labelled ones among them."""
    tagger = toxicity.train(docs, shared.table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), tagger, prefix="toxic_").where("toxic_predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one that names it, or one of its rows if its doc_id repeats.

    The rows to drop are few beside those to keep, so they are what is joined: a broadcast while small, else one shuffle."""
    rows = _identified(docs)
    found = shared.staged(simhash_dedup.near_duplicates(rows, words_per_shingle=SHINGLE, keep=("uid",)), "groups")
    lead = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("lead")
    leads = found.groupBy("group").agg(lead, F.count("*").alias("n")).where("n > 1").select("group", F.col("lead.uid").alias("lead"))
    leads = shared.staged(leads, "leads")
    copies = shared.staged(found.join(leads, "group").select("uid", (F.col("uid") == F.col("lead")).alias("first")), "copies")
    leading = copies.where("first").groupBy("uid").agg(F.count("*").alias("n"))
    alike = _small(leading.where("n > 1").select("uid"))
    gone = _small(copies.where("not first").select("uid").distinct().unionByName(alike))
    kept = rows.join(gone, "uid", "left_anti").select(*COLUMNS)
    return kept.unionByName(shared.one_of_each(rows.join(alike, "uid", "left_semi"), "uid", *COLUMNS).select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated passages."""
    kept = suffix_dedup.remove_repeats(docs, keep=("lang", "source"), as_text=True)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Rows alike in every column are taken as often as all of them together."""
    rows = _identified(docs)
    taken = mixing.taken_copies(rows, keep=("uid",)).where("copies > 0").select(F.col("own.keep0").alias("uid"), "n", "copies")
    taken = shared.staged(taken, "taken")
    alike = _small(taken.where("n > 1").select("uid", "copies"))
    single = rows.join(taken.where("n = 1").select("uid", "copies"), "uid")
    several = shared.one_of_each(rows.join(alike.select("uid"), "uid", "left_semi"), "uid", *COLUMNS).join(alike, "uid")
    # A row taken often is repeated in two steps, so that no task writes all of it.
    steps = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(mixing.ALIKE).cast("long"))
    several = several.withColumn("from", F.explode(steps)).repartition("uid", "from")
    several = several.withColumn("k", F.explode(F.sequence("from", F.least(F.col("from") + mixing.ALIKE, F.col("copies")) - 1)))
    single = single.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return single.select(*COLUMNS).unionByName(several.select(*COLUMNS))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token windows; the last stage."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL cannot fit the tagger, hash shingles, sort suffixes, sample by the cube or tokenize; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    base = f"{shared.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = shared.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = shared.made()
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        shared.sweep(spark, before)
        if k:
            shared.delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    shared.keep_until_exit(base, spark)
    return docs
