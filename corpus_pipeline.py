"""documents, cleaned and packed: language ID, line dedup, near-dedup, mixing and packing, each over all that is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import language, lines, minhash, mixing, packing
from quire.llm.common import cut, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; lang becomes that language."""
    judged = language.identify(docs, "doc_id", "text", F.col("lang"), F.col("source"), keep=COLUMNS)
    return judged.filter("accepted").select("doc_id", "text", F.col("language").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; a document goes if nothing but blanks is left of it."""
    cleaned = lines.dedup_lines(docs, columns=COLUMNS, least_equal=lines.LEAST_EQUAL)
    left = cleaned.filter("n_dropped = 0 or length(trim(both from text)) > 0")
    return left.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the least doc_id. Rows that repeat a doc_id are told apart by
    all they hold, nulls included; of rows alike in all, one stays. Rows with a null doc_id stay."""
    keyed = docs.withColumn("row_key", F.when(F.col("doc_id").isNotNull(), F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])))
    near = cut(minhash.near_duplicates(keyed, "row_key").filter("component_id is not null").select("row_key", "component_id").distinct())
    group = near.join(near.filter("row_key <> component_id").select("component_id").distinct(), "component_id")
    group = cut(group.join(keyed.select("row_key", "doc_id"), "row_key").distinct())
    stay = group.groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("least"))
    gone = group.join(stay, "component_id").filter(F.col("row_key") != F.col("least.row_key")).select("row_key").distinct()
    left = keyed.join(gone, "row_key", "left_anti")
    again = cut(keyed.filter("row_key is not null").groupBy("row_key").count().filter("count > 1").select("row_key"))
    if not again.isEmpty():
        left = left.join(again, "row_key", "left_anti").unionByName(left.join(again, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return left.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, columns=COLUMNS).filter("kept").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A tokenizer and a fitted language model are no SQL.
ORACLE_SQL = None
