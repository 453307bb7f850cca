"""Five stages from documents to token files; each takes and returns whole tables.

Rules for odd input: rows with null texts pass the filters (no votes, no shingles, no windows), count 0 words in the mix and so are not
taken by it; repeated ids leave the near-duplicate stage once; null ids link with nothing and stay; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.llm import decontam, minhash, mixing, tokenfiles, toxicity
from contractlens.llm.common import drop, small, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects. Written here, so that whole texts reach Python in batches of bounded bytes."""
    return written(toxicity.reject(docs, table(spark, sf_dir, "labels")), "pipeline-clean")


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the least id."""
    found = minhash.near_duplicates(docs)
    marks = written(found.select("doc_id", "kept"), "pipeline-marks")
    drop(*found.work_tables)
    gone = written(marks.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), "pipeline-gone")
    left = docs.join(small(gone), F.col("doc_id") == F.col("gone"), "left_anti")
    again = written(marks.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "pipeline-again")
    if not again.limit(1).count():
        return left
    rest = [c for c in docs.columns if c != "doc_id"]
    once = left.join(small(again), F.col("doc_id") == F.col("again"), "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    return left.join(small(again), F.col("doc_id") == F.col("again"), "left_anti").unionByName(once.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a whole window of a benchmark item, or two items too short for one."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents to meet the sources' target weights."""
    return mixing.emit(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files; one row per document read back from them."""
    return tokenfiles.store(spark, docs).select("doc_id", "start", "n_tokens", "ids_crc32")


#: Stage name and function (spark, docs, sf_dir) -> DataFrame, in order.
STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash", minhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Stages 2 and 8 learn and hash in ways SQL cannot express; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
