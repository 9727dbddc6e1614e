"""From raw documents to packed sequences, in five stages.

Every stage takes what its predecessor wrote and applies one operator to all of it. The first
four return the columns of ``documents``; rows with a NULL id or text, repeated rows
and empty tables pass as the operators define. Rows are told apart by doc_id and ``xxhash64(text)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.benchmark_scan import contamination
from textloom.llm.best_fit import pack_documents
from textloom.llm.near_dups import near_duplicates
from textloom.llm.substrings import remove_repeats
from textloom.llm.toxicity import LIMIT, score_documents, train
from textloom.workspace import freeze, temporary_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list[Column]:
    """The documents' columns; a name may hold a dot."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _decided(spark: SparkSession, decide: Callable[[], DataFrame], name: str) -> DataFrame:
    """A stage's decisions as a table of their own; the operator's other tables are removed at once."""
    with temporary_tables(spark):
        return freeze(decide(), name, outside=True)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the limit."""
    model, score = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), _unused(docs, "score")
    return score_documents(docs, model, score).where(F.col(score) < LIMIT).select(_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each near-duplicate component."""
    name = _unused(docs, "dropped_id")
    dropped = _decided(spark, lambda: near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "dropped")
    return docs.join(dropped, F.col("doc_id") == F.col(name), "left_anti")


def _same_row(docs: DataFrame, row_id: str, key: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(row_id)) & (F.xxhash64(F.col("text")) == F.col(key))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has. Texts that lose words are their kept words with one space
    between, and ``n_chars`` follows; others stay as they are."""
    row_id, key, kept = (_unused(docs, name) for name in ("cut_id", "cut_key", "cut_text"))
    cut = _decided(spark, lambda: remove_repeats(docs, with_text=True).where("n_removed > 0").select(
        F.col("doc_id").alias(row_id), F.col("text_key").alias(key), F.col("kept_text").alias(kept)).dropDuplicates([row_id, key]), "cut")
    joined = docs.join(cut, _same_row(docs, row_id, key), "left")
    new = {"text": F.coalesce(F.col(kept), F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select([new[c].alias(c) if c in new else column for c, column in zip(docs.columns, _columns(docs))])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    row_id, key = (_unused(docs, name) for name in ("found_id", "found_key"))
    found = _decided(spark, lambda: contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(
        F.col("doc_id").alias(row_id), F.col("text_key").alias(key)).distinct(), "found")
    return docs.join(found, _same_row(docs, row_id, key), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return _decided(spark, lambda: pack_documents(docs), "pieces")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: A trained network and tokenisation are not SQL; the tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again. Only the last table stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary_tables(spark):
        for name, stage in STAGES:
            with temporary_tables(spark):
                docs = freeze(stage(spark, docs, sf_dir), name, outside=True)
        return freeze(docs, "pipeline", outside=True)
