"""The corpus pipeline: language identification, near-duplicate removal, benchmark decontamination, mixing, sharding.

Each stage takes what the one before kept; its result is written as Parquet and
read again, so a lost executor costs no more than the tasks it had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm import decontaminate, langid, mixing, neardup, reshard
from citegraph.llm.shared import written

#: A text in no language that the model knows is less sure than this of any.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and a language of at least LEAST_SCORE; the model learns from the labelled rows that are not held out.

    Where no row has a language label nothing can be learned, and only texts without letters go.
    """
    model = langid.train(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    return langid.confident(docs, model, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id; a class without any keeps the text of the least md5.

    Null texts are one empty text, repeated rows one row.
    """
    return neardup.keep_first(docs, neardup.near_duplicate_classes(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no consistent template window with a benchmark item; each row is judged by its own text, null and empty ones are clean."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: its source's share of words decides; null texts have no words and are taken by their source's whole rounds alone."""
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot of every row; null texts have the size 1."""
    placed, _ = reshard.reshard(docs)
    return placed


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: Learning, signatures and block plans are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; an empty table gives an empty one, further columns are carried up to the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
