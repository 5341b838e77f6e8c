"""From documents to training sequences: quality, language, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.llm import language_id, minhash_join, packing, prefix_free, quality_lm, token_counts
from wagerlake.llm.common import Staging, shared_dir, staged, table
from wagerlake.llm.queries import PIECE_BPE, tokenizer_path


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the ids in gone; rows without an id stay."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


_staging: dict[str, Staging] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage is called with the written result of the one before, whose own tables in the shared folder can go then.

    Only those of the stage before go, and only those that its last call staged: callers that run several pipelines at once in one
    process use run(), which ties the tables to its own steps.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [name for name, _ in STAGES]
        if (k := names.index(f.__name__)) and names[k - 1] in _staging:
            _staging.pop(names[k - 1]).drop(spark)
        with Staging() as _staging[f.__name__]:
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text of their language; see quality_lm.classify.

    Null, empty and short texts, rows without an id and languages without trusted text stay. Rows of one doc_id stay or go together: one rejected
    row rejects all. An empty table gives none; extra columns are kept.
    """
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return _without(docs, quality_lm.classify(docs, trusted).where("not kept"))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which some language's model is sure; see language_id.identify. Models learn from the stage's own documents.

    Texts without a letter (null and empty ones too) go; rows without an id stay. Rows of one doc_id go together if one is
    rejected. An empty table gives none; extra columns are kept.
    """
    known = docs.select("doc_id", "lang").where("lang is not null")
    fold = language_id.fold(F.col("doc_id"))
    return _without(docs, language_id.identify(docs, known.where(fold != 1), known.where(fold == 1)).where("not accepted"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, and of its rows with different texts the one of the least text key.

    Rows that repeat a doc_id with texts of different groups stay, one a group. Of equal rows one stays, of rows that share id and text the
    least. Texts without words are a group of their own for each doc_id and text; rows without an id stay. Extra columns are kept.
    """
    found = staged(minhash_join.near_duplicates(docs).select("doc_id", "text_key", "group_id"), "groups")
    key = F.struct("doc_id", "text_key")
    rows = found.groupBy("doc_id", "text_key", "group_id").agg(F.count("*").alias("rows"))
    first = rows.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct(key, "rows")).alias("k")).select("k.col1.*", "k.rows")
    first = staged(first.unionByName(rows.where("group_id is null").select("doc_id", "text_key", "rows")), "first")
    text = minhash_join.text_key()
    named = docs.withColumn("_key", text)
    pick = lambda keys: named.join(keys.select("doc_id", F.col("text_key").alias("_key")), ["doc_id", "_key"], "left_semi")
    out = pick(first.where("rows = 1")).select(*docs.columns).unionByName(docs.where("doc_id is null"))
    several = first.where("rows > 1")
    if several.isEmpty():
        return out
    least = pick(several).groupBy("doc_id", "_key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return out.unionByName(least.select("row.*"))


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that a document with a smaller id has too; n_chars follows the text.

    Null, empty and short texts and rows without an id stay as they are; rows of one doc_id don't cut each other. An empty table gives none.
    """
    cut = prefix_free.remove_repeats(docs).where("n_removed > 0").select("doc_id", "text_sha256", "kept_text").dropDuplicates(["doc_id", "text_sha256"])
    met = docs.withColumn("text_sha256", F.sha2(F.encode("text", "UTF-8"), 256)).join(cut, ["doc_id", "text_sha256"], "left")
    text = F.coalesce("kept_text", "text")
    n = F.when(F.col("kept_text").isNotNull(), F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return met.select(*(text.alias(c) if c == "text" else n.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of several lengths; see packing.pack. Documents without tokens (null, empty) have no row."""
    return packing.pack(token_counts.token_counts(docs, tokenizer_path(PIECE_BPE)))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packed", packed)]
#: Language models and best fit can't be said in SQL; tests/llm has plain versions of each operator and runs the stages on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table; each one's result is written, and its own staged tables go then."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with Staging() as mine:
            stage.__wrapped__(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        mine.drop(spark)
        docs = spark.read.parquet(f"{top}/{name}")
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
