"""The corpus pipeline: documents through five stages, each calling one operator of loomgraph.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; the last returns the mixture with its texts (see loomgraph.llm.source_mixing).

Defined results: null and empty texts are no toxic ones if an empty bag isn't, no near copies, no leaks and hold no
secrets, and come along once in every full epoch of their source; rows without an id are never taken for copies of each other
by id, and all go on; of rows that repeat an id one stays; an empty table gives an empty mixture; columns besides those of
documents, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, near_dedup, secret_scan, source_mixing, toxicity
from loomgraph.llm.common import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the classifier rejects (score 0.5 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels, window_words=toxicity.WORST_WINDOW))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    found = near_dedup.near_duplicates(docs, shingle_words=5, percent=80)
    return near_dedup.distinct_groups(docs, found)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a window of ten words of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_leaks(docs, benchmark, window=10)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and counts characters anew."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents to train on, in epochs: every kept document at least once, no source over four times. doc_id, source, text,
    tokens, epoch, block and place, a row for each time that a document is taken.

    The mixture has an id for each document: its doc_id, or a hash of source and text for documents without one, so that
    texts find their rows. Equal documents without an id have one hash, a row each in the mixture, and one text."""
    own = -F.abs(F.xxhash64("source", "text") / 2).cast("long") - 1
    named = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).withColumn("row", F.coalesce(F.col("doc_id").cast("long"), own))
    mixture = source_mixing.mix_sources(named, max_epochs=4.0, id_col="row").withColumnRenamed("doc_id", "row")
    with_id = named.where("doc_id is not null").select("row", "doc_id", "text")
    without = named.where("doc_id is null").select("row", "doc_id", "text").dropDuplicates(["row"])
    mixed = mixture.join(with_id.unionByName(without), "row")
    return mixed.select("doc_id", "source", "text", "tokens", "epoch", "block", "place")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs


#: The classifier can't be expressed in SQL; tests/llm compares all stages with a brute-force version.
ORACLE_SQL = None
