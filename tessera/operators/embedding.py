"""Embedding documents and passages: an injected encoder in Arrow batches, incremental by anti join."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.passages import chunked
from tessera.functions.text import title_and_abstract
from tessera.functions.vector import dot, literal
from tessera.operators.joins import changed, pending

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 256) -> Encoder:
    """Unit-length hashed term frequencies: an encoder that needs no model.

    A text without words, or whose words cancel each other out, counts as one term, so that
    every text that is not empty has unit length.
    """

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 1 << 31 else -1
            if t and not out[i].any():
                h = zlib.crc32(t.encode())
                out[i, h % dim] = 1 if h & 1 << 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return encode


def encoded(df: DataFrame, text: str, factory: Callable[[], Encoder], batch: int = 64) -> DataFrame:
    """df with ``vector``; the encoder is made once a task and sees bounded batches."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for pdf in frames:
            texts = pdf[text].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
            yield pdf.assign(vector=[v.tolist() for v in vectors])

    return df.mapInPandas(run, schema)


def embed_documents(documents: DataFrame, embeddings: DataFrame, model: str, factory: Callable[[], Encoder], scope: str = "title_abstract") -> DataFrame:
    """New embeddings of the documents (document_id, title, abstract) that have none for the model and scope."""
    done = embeddings.where((F.col("model") == model) & (F.col("scope") == scope))
    todo = pending(documents, done, ["document_id"]).select("document_id", title_and_abstract(F.col("title"), F.col("abstract")).alias("text")).where("text <> ''")
    out = encoded(todo, "text", factory)
    return out.select("document_id", F.lit(model).alias("model"), F.lit(scope).alias("scope"), F.size("vector").alias("dim"), "vector")


def embed_full_text(documents: DataFrame, chunks: DataFrame, model: str, factory: Callable[[], Encoder]) -> tuple[DataFrame, DataFrame]:
    """Chunks of documents (document_id, body) whose text is new or changed, and the held chunks that stay."""
    now = documents.where("body IS NOT NULL").withColumn("source_sha256", F.sha2("body", 256))
    held = chunks.where(F.col("model") == model)
    todo = changed(now, held.select("document_id", "source_sha256").distinct(), "document_id", "source_sha256")
    passages = chunked(todo, "document_id", "body").join(todo.select("document_id", "source_sha256"), "document_id")
    fresh = encoded(passages, "passage", factory).select("document_id", F.lit(model).alias("model"), "chunk_index", "section", "char_start", "char_end", "source_sha256", F.size("vector").alias("dim"), "vector")
    return fresh, chunks.join(todo.select("document_id"), "document_id", "left_anti")


def nearest(vectors: DataFrame, query: list[float], k: int, key: str) -> DataFrame:
    """Exact top k by dot product: one scan, k rows a task."""
    return vectors.select(key, dot(F.col("vector"), literal(query)).alias("score")).orderBy(F.desc("score"), key).limit(k)
