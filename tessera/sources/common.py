"""Readers of payload files: JSON documents, XML records, delimited tables, raw payloads with a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import TABLES


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON value a file, with a declared schema; fields that are missing are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def xml_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Rows (xml): one a record element.

    Files are cut at the closing tag while they are read, so large files split and no
    task holds more than one record at a time; several concatenated documents in a file
    make no difference.
    """
    parts = spark.read.option("lineSep", f"</{tag}>").text(path)
    body = F.regexp_extract("value", rf"(?s)(<{tag}(?:\s[^>]*)?>.*)$", 1)
    # What is no record is null, so that no parser ever sees it, in whatever order filters run.
    return parts.select(F.when(body != "", F.concat(body, F.lit(f"</{tag}>"))).alias("xml")).where("xml IS NOT NULL")


def one(xml: Column, path: str) -> Column:
    """Text of the first node of a path, null if there is none."""
    return F.nullif(F.trim(F.get(F.xpath(xml, F.lit(f"{path}/text()")), F.lit(0))), F.lit(""))


def many(xml: Column, path: str) -> Column:
    """Texts of all nodes of a path."""
    return F.filter(F.transform(F.xpath(xml, F.lit(f"{path}/text()")), lambda x: F.trim(x)), lambda x: x != "")


def mixed_text(xml: Column, path: str) -> Column:
    """All text below the first node of a path: inline markup is kept once."""
    return F.nullif(F.trim(F.regexp_replace(F.xpath_string(xml, F.lit(path)), r"\s+", " ")), F.lit(""))


def delimited(spark: SparkSession, path: str, sep: str = "\t", required: tuple[str, ...] = (), **options: object) -> DataFrame:
    """A table with a header, all columns as text; required columns are checked."""
    df = spark.read.options(header=True, sep=sep, inferSchema=False, **options).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: columns are missing: {missing}")
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of a declared table, in order; what the source lacks is null."""
    target = df.sparkSession.createDataFrame([], TABLES[table]).schema
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def payload_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, bytes, sha256, modified) of raw payload files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def damaged(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Payloads whose bytes no longer match the manifest, or that are gone."""
    current = now.select("path", F.col("sha256").alias("_now"))
    return manifest.join(current, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("_now"))).drop("_now")


def cache_summary(manifest: DataFrame, source: Column) -> DataFrame:
    return manifest.groupBy(source.alias("source")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def ranges(low: int, high: int, count, most: int) -> list[tuple[int, int]]:
    """Bisect a range of years until no part has more than ``most`` records; a single year is never cut."""
    if low == high or count(low, high) <= most:
        return [(low, high)]
    mid = (low + high) // 2
    return [*ranges(low, mid, count, most), *ranges(mid + 1, high, count, most)]
