"""Corpus pipeline: the stages over documents, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of their input, further ones among them; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint_dir, cut, ship, spilled
from graphloom.llm.decontaminate import find_leaks
from graphloom.llm.jaccard import jaccard_components
from graphloom.llm.language_id import fit as fit_language
from graphloom.llm.language_id import keep_identified
from graphloom.llm.packing import pack
from graphloom.llm.quality import fit as fit_ratio
from graphloom.llm.quality import keep_selected, target_sample
from graphloom.llm.queries import QUALITY_CUTOFF

#: A document without a language of at least this score is rejected.
LANGUAGE_SCORE = 0.4
#: Near duplicates: word shingles and similarity in per cent.
SHINGLE, SIMILARITY = 5, 80
#: Ids to drop are broadcast up to this many rows (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(rows, key): a column that tells all rows apart. doc_id where none is null or repeated; else rows are numbered in a written copy, where the numbers stay."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    key = "row"
    while key in docs.columns:
        key += "_"
    return spilled(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is not among ids(doc_id)."""
    ids = cut(ids.select(F.col("doc_id").alias(key)).distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language the byte network tells; null and empty texts, and all where nothing can be learned, are rejected."""
    ship(spark)
    return keep_identified(docs, fit_language(docs), LANGUAGE_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the k documents of the largest perturbed log weights; k is how many are not plainly likelier as raw text. Null and empty texts weigh 0 and count among those; rows that tie with the last stay too."""
    ship(spark)
    good = cut(target_sample(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return keep_selected(docs, fit_ratio(docs, good), cutoff=QUALITY_CUTOFF)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one of the smallest id stays: exactly one row, the first where ids repeat or are missing. Texts without words are similar to none and stay."""
    ship(spark)
    rows, key = numbered(docs)
    found = jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), SHINGLE, SIMILARITY)
    return without(rows, key, found.where("doc_id != component_id")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark item's words under its template, whatever their ids. Null and empty texts stay."""
    ship(spark)
    rows, key = numbered(docs)
    found = find_leaks(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(rows, key, found).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; every row has a piece, null and empty texts one of their end alone."""
    ship(spark)
    return pack(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
#: Models and tokens are not SQL: stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{base}/{name}")
    return docs
