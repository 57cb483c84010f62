"""The corpus pipeline: five stages from raw documents to a weighted mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet in the shared folder and read again as the next stage's docs.  All stages but the
last return the columns of ``documents`` (doc_id, text, lang, source, n_chars).

1. Language ID: documents without an identified language (no text, no letter), or with a
   share of their language under ``LEAST_SCORE``, go.
2. Line dedup: recurring line templates go; a document left without any line goes.
3. MinHash near-dedup (five-word shingles, similarity 0.8): the document with the smallest
   identifier stays of each group.
4. Benchmark decontamination: documents that hold a ten-word passage of the benchmark go.
5. Mixing: the words that each document gives to a mix of the sources at target weights.

Awkward rows, stage by stage (see the operators for the rest): null and empty texts and
texts without a letter go in stage 1; a null identifier is a document of its own text, and
the first one in stage 2; exact repeats of a row stay until stage 3, which keeps one; of one
identifier with two texts each is judged by its text; a null source is a source of its own
in stage 5; very long texts go through whole; an empty table gives empty tables; columns of
the input beyond those of ``documents`` are dropped by stage 1, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontam import mark_contamination
from tessera.llm.langid import fold_of, identify, train
from tessera.llm.linededup import dedup_lines
from tessera.llm.mixing import mix, words_taken
from tessera.llm.neardup import drop_near_duplicates
from tessera.operators.lineage import new_folder, remove

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.4
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the field learns from two thirds of them by identifier."""
    field = train(docs.where(F.coalesce(fold_of(F.col("doc_id"), 3) != 1, F.lit(True))))
    return identify(docs, field, keep=COLUMNS[1:]).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; one that loses all its words goes."""
    out = dedup_lines(docs, keep=COLUMNS[2:])
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~emptied)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, and of each repeated row."""
    return drop_near_duplicates(docs, k=5, percent=80).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    marked = mark_contamination(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=True, keep=COLUMNS[2:])
    return marked.where(F.size("hits") == 0).withColumnRenamed("clean_text", "text").select(*COLUMNS)


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that each document gives to the mix, and which shards draw them."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", words_taken().alias("taken"), "draws")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("weights", weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    folder = new_folder(spark, "pipeline")
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:  # what the stage read is no longer needed
            remove(spark, done)
        done = f"{folder}/{name}"
    return docs
