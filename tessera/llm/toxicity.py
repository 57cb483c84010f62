"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character 3- to 5-grams within words (a word's ends count as a
character), present or absent in the whole text.  From labelled rows come each feature's
log-count ratio and a chi-square test of its presence against the label; every feature that
passes the test at ``SIGNIFICANT`` (p < 0.001) takes part, scaled by its ratio, in a logistic
regression over sparse rows.

Training uses a bounded sample of labelled rows: at most ``per_class`` of either label, by
the order of a hash of the identifier; their whole texts are read.  The intercept is set back
to the label shares of all labelled rows.  Scoring reads every whole text, in one pass
without a shuffle.

Defined results: null and empty texts get the score of a text without features; with one
label only (or none) every text gets the share of label 1 among the labelled rows (0
without any); rows without a label, or with a null one, are not learned from; an
identifier with two labels counts as toxic, one with two texts is learned from by the
smaller; ties of the hash go by identifier; very long texts are read whole, repeated rows
scored each; an empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ALPHA, GOLDEN, Shared, bounded_batches, filled, map_slices, mixed, raw, sliced
from tessera.operators.lineage import reliable

BITS = 20
SIZE = 1 << BITS
ORDERS = (3, 4, 5)
#: Chi-square with one degree of freedom at p = 0.001.
SIGNIFICANT = 29.8
PER_CLASS = 3000


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the identifier as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def grams(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (row, feature), of all features or of those marked in wanted."""
    data, offsets = raw(texts)
    # One space at either end of a word and none besides; rows are kept apart by a space.
    mapped = np.full(len(data) + len(offsets), 32, np.uint8)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    mapped[np.arange(len(data)) + rows + 1] = ALPHA[data]
    owner = np.append(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 1), max(0, len(offsets) - 2))
    gap = mapped == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[:-1] |= ~gap[1:]
    mapped, owner, gap = mapped[keep].astype(np.uint64), owner[keep], gap[keep]
    gaps = np.append(0, np.cumsum(gap))
    found = []
    for n in ORDERS:
        size = len(mapped) - n + 1
        if size < 1:
            continue
        h = np.full(size, np.uint64(n))
        for j in range(n):
            h = h * GOLDEN + mapped[j : j + size]
        h = (mixed(h) >> np.uint64(64 - BITS)).astype(np.int64)
        inner = gaps[n - 1 : n - 1 + size] == gaps[1 : 1 + size]
        if wanted is not None:
            inner &= wanted[h]
        at = np.flatnonzero(inner)
        # A gram that ends in the space before the next row's first word belongs to the row of its letters.
        found.append(owner[at + 1] * SIZE + h[at])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & (SIZE - 1)


@dataclass
class Model:
    """Weights by hashed feature, the intercept, and which features count."""

    weights: np.ndarray
    intercept: float
    wanted: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.intercept)
        if self.wanted.any():
            rows, features = grams(texts, self.wanted)
            z += np.bincount(rows, weights=self.weights[features], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, int, int]:
    """The sampled rows (text, y) in a few partitions; how many rows have label 0 and 1."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picks = [named.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(picks[0].union(picks[1]))  # at most 2 * per_class identifiers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return reliable(rows.select("text", "y")).repartition(4), counts.get(0, 0), counts.get(1, 0)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labels (doc_id, y in 0 and 1)."""
    bounded_batches(docs.sparkSession)
    sample, zeros, ones = _sample(docs, labels, per_class)
    if not zeros or not ones:
        share = ones / (zeros + ones) if zeros + ones else 0.0
        return Model(np.zeros(SIZE), 700.0 if share == 1 else -700.0, np.zeros(SIZE, bool))

    def count(batches):
        seen, rows = np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64)
        for part in sliced(batches, "text"):
            y = part.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            who, features = grams(filled(part.column("text")))
            seen += np.bincount(y[who] * SIZE + features, minlength=2 * SIZE).reshape(2, SIZE)
            rows += np.bincount(y, minlength=2)
        yield pa.RecordBatch.from_arrays([pa.array([seen.astype(np.int32).tobytes()], pa.binary()), pa.array([rows.tolist()], pa.list_(pa.int64()))], ["seen", "rows"])

    parts = sample.mapInArrow(count, "seen binary, rows array<long>").collect()  # one row for each of 4 partitions
    seen = sum(np.frombuffer(p.seen, np.int32).reshape(2, SIZE).astype(np.int64) for p in parts)
    rows = np.sum([p.rows for p in parts], axis=0)
    if not rows.all():
        return Model(np.zeros(SIZE), float(np.log((ones + 0.5) / (zeros + 0.5))), np.zeros(SIZE, bool))
    ratio = np.log((seen[1] + 1) / (seen[1].sum() + SIZE)) - np.log((seen[0] + 1) / (seen[0].sum() + SIZE))
    with_, without = seen.astype(float), rows[:, None] - seen
    total = with_.sum(axis=0) * without.sum(axis=0) * rows[0] * rows[1]
    chi = np.divide(rows.sum() * (with_[1] * without[0] - with_[0] * without[1]) ** 2, total, out=np.zeros(SIZE), where=total > 0)
    wanted = chi >= SIGNIFICANT
    chosen = np.flatnonzero(wanted)

    def encode(part: pa.RecordBatch) -> pa.RecordBatch:
        who, features = grams(filled(part.column("text")), wanted)
        ends = np.searchsorted(who, np.arange(part.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.searchsorted(chosen, features).astype(np.int32)))
        return pa.RecordBatch.from_arrays([lists.cast(pa.list_(pa.int32())), part.column("y")], ["x", "y"])

    packed = map_slices(sample, encode, "x array<int>, y int").toArrow()  # the sampled rows' features that passed
    xs, y = packed.column("x").combine_chunks(), packed.column("y").to_numpy().astype(np.float64)
    sizes = np.diff(xs.offsets.to_numpy())
    row, feature = np.repeat(np.arange(len(y)), sizes), xs.flatten().to_numpy().astype(np.int64)
    # Rows in one order whatever order they came in, so that sums are the same.
    key = np.bincount(row, weights=np.sin(feature + 1.0), minlength=len(y))
    place = np.empty(len(y), np.int64)
    order = np.lexsort([key, sizes, y])
    place[order] = np.arange(len(y))
    row, y = place[row], y[order]
    by = np.lexsort([feature, row])
    w, b = _logistic(row[by], feature[by], ratio[chosen], y)
    weights = np.zeros(SIZE)
    weights[chosen] = w * ratio[chosen]
    shift = np.log(ones / zeros) - np.log(rows[1] / rows[0])
    return Model(weights, float(b + shift), wanted)


def _logistic(row: np.ndarray, feature: np.ndarray, scale: np.ndarray, y: np.ndarray, steps: int = 200, penalty: float = 1.0, rate: float = 0.03) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by Adam on the whole sample: sparse rows of scaled features."""
    n, d = len(y), len(scale)
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=(w[:d] * scale)[feature], minlength=n) + w[d]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        g = np.append(np.bincount(feature, weights=(p - y)[row], minlength=d) * scale / n + penalty * w[:d] / n, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:d], float(w[d])


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score), one for each row of docs."""
    shared = Shared(docs.sparkSession, model)  # of the size of the feature table

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(filled(part.column("text"))))], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(narrow, run, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = train(docs, labels.where(~held_out).select("doc_id", F.col("toxic").cast("int").alias("y")))
    scored = score_texts(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
