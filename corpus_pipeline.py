"""A training-corpus pipeline of five of the operators. Each stage reads what the stage before wrote.

Defined cases: decisions are on rows, told apart by id and text, so that rows which share an id but not the text are documents of their own;
rows equal in id and text become one in the exact stage; a row without doc_id goes if an equal text has one; null and empty texts have no
letter and go in the first stage; other columns stay as they are; an empty table stays empty. The last stage needs a table that
was read from files, as the order of the mixing stage is the order of its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common, exact_dedup, language_id, mixing, near_dedup, registry, sentencepiece_codec

#: SQL can express neither the language models nor the sketches.
ORACLE_SQL = None


KEY = "_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of their rows: a hash of id and text, so that decisions are on rows and not on all rows of an id."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Keyed docs without the rows of the dropped keys, which are broadcast only while they are few."""
    dropped = common.stored(dropped.select(KEY).distinct())
    return docs.join(common.checked_broadcast(dropped), KEY, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; one without any letter goes."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows equal in both, one. A row without doc_id counts as the smallest."""
    rows = _keyed(docs)
    decisions = common.stored(exact_dedup.exact_duplicates(rows.select("doc_id", "text", KEY), (KEY,)).select(KEY, F.coalesce("kept", F.col("keep_id").isNull()).alias("kept")))
    rows = _without(rows, decisions.filter("not kept"))
    again = common.stored(decisions.filter("kept").groupBy(KEY).agg(F.count("*").alias("n")).filter("n > 1").select(KEY))
    if again.take(1):
        again = common.checked_broadcast(again)
        rows = rows.join(again, KEY, "left_anti").union(rows.join(again, KEY, "left_semi").dropDuplicates([KEY]))
    return rows.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the row with the smallest doc_id. Rows are told apart by id and text."""
    rows = _keyed(docs)
    found = near_dedup.near_duplicates(rows.select(F.col(KEY).alias("doc_id"), "text")).select(F.col("doc_id").alias(KEY), "component_id").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", KEY).alias("place")
    placed = common.stored(found.join(rows.select(KEY, place).distinct(), KEY))
    placed = common.with_group(placed, ["component_id"], [KEY], best=("min", "place"))
    return _without(rows, placed.filter(~F.col("place").eqNullSafe(F.col("best")))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the mixed order: files are ranges of slots, rows follow slot and place."""
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with merge-dropout, checked by decoding. (file_no, row_no) is the mixed order, as the mixing stage wrote it:
    readers pack files anew, so the order is read from where each row lies."""
    file_no = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file_no")
    rows = docs.select("doc_id", "text", file_no, F.col("_metadata.row_index").alias("row_no"))
    return sentencepiece_codec.encoded(rows, registry.PIECES, carried=("file_no", "row_no"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's table is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
