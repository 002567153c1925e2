"""From documents to training shards: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.decontaminate import decontaminated
from lumora.llm.jaccard_join import jaccard_classes
from lumora.llm.mixing import mixed
from lumora.llm.registry import byte_bpe
from lumora.llm._shared import written
from lumora.llm.token_records import token_records
from lumora.llm.toxicity import without_toxic


#: The column that tells rows apart within the Jaccard stage.
ROW = "jaccard_row"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Rows without text stay, repeated rows stay or go alike; no rows, no rows."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id stays; rows without an id come after all others.

    Each row is decided for itself, whatever others share its id. Rows without words stay, but of those with
    equal ids and equal texts one; such rows without an id stay all. All other columns come along unread. An
    empty table stays empty.
    """
    rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "jaccard-rows")
    classes = jaccard_classes(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias("own"), "n_shingles", F.col("component_id").alias("class"))
    first = lambda: F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias("stays")
    placed = written(rows.select("doc_id", ROW).join(classes, F.col(ROW) == F.col("own")), "jaccard-rows-placed")
    linked = placed.where("n_shingles > 0").groupBy("class").agg(first())
    blank = rows.join(placed.where("n_shingles = 0 and doc_id is not null").select("own"), F.col(ROW) == F.col("own")).groupBy("doc_id", "text").agg(first())
    unnamed = placed.where("n_shingles = 0 and doc_id is null").select(F.col(ROW).alias("stays"))
    stays = linked.select("stays").unionByName(blank.select("stays")).unionByName(unnamed)
    return rows.join(stays, F.col(ROW) == F.col("stays"), "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows without text stay, repeated rows stay or go alike; no rows, no rows."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights, documents repeated as often as they are taken.

    Rows without words are not taken; a null source is one of its own; an empty table stays empty.
    """
    return mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records in binary files; a row per record, read back from them. Null texts count as empty, rows without an id come first; no rows, no rows."""
    return token_records(docs, byte_bpe(), end_id=2)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_records", token_stage),
]
#: Learnt scores and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
