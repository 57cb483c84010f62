"""Best row per key, ordered dedup, adjustments along a window, and bounded top-k.

Every tie is broken by an explicit key, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import ranked, running


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def first_distinct(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Ordered dedup: the first row of each key, and its new rank in the order; keys of one ordinal by key."""
    return ranked(best_per_key(df, [key], [F.col(ordinal)]), [F.col(ordinal), F.col(key)])


def adjusted_p(df: DataFrame, p: str, key: str, family: list[str]) -> DataFrame:
    """Benjamini-Hochberg within each family: column ``fdr``.

    A family is one analysis' tests and goes through one window; ``ordering.adjusted_p``
    does the same for families of any size.
    """
    up = Window.partitionBy(*family).orderBy(p, key)
    rows = df.withColumns({"_rank": F.row_number().over(up), "_m": F.count("*").over(Window.partitionBy(*family))})
    back = Window.partitionBy(*family).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("fdr", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(back))).drop("_rank", "_m")


def running_min(df: DataFrame, keys: list[str], order: str, value: str) -> Column:
    """The smallest value so far along the order."""
    return F.min(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def quantile_normalised(df: DataFrame, sample: str, key: str, value: str) -> DataFrame:
    """Each sample's n-th smallest value becomes the mean of all samples' n-th smallest.

    The mean sums decimals, so it does not depend on the order that partitions give.
    """
    placed = running(df, [sample], [F.col(value), F.col(key)], sums={"_nth": F.lit(1).cast("long")})
    reference = placed.groupBy("_nth").agg((F.sum(F.col(value).cast("decimal(38,10)")).cast("double") / F.count(value)).alias("normalised"))
    return placed.join(reference, "_nth").drop("_nth")


def retained(df: DataFrame, series: list[str], n: str, share: float) -> DataFrame:
    """Rows that still report at least a share of the largest group of their series."""
    peak = F.max(n).over(Window.partitionBy(*series))
    return df.withColumn("_peak", peak).where(F.col(n) >= F.col("_peak") * share).drop("_peak")


def top_with_penalty(df: DataFrame, raw: str, penalty: Column, key: str, k: int) -> DataFrame:
    """Top k by score less a penalty, then raw score, then key."""
    return df.withColumn("adjusted", F.col(raw) - penalty).orderBy(F.desc("adjusted"), F.desc(raw), key).limit(k)


def shortlist(df: DataFrame, raw: str, k: int, most_penalty: float) -> DataFrame:
    """Rows that can still reach the top k whatever their penalty: the raw score of the k-th less the largest penalty bounds it."""
    kth = df.select(raw).orderBy(F.desc(raw)).limit(k).agg(F.min(raw))
    return df.where(F.col(raw) >= kth.scalar() - most_penalty)


def diverse(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group, in score order: the greedy pick is the group's own prefix."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_nth") <= most).drop("_nth")


def duplicate_flags(df: DataFrame, key: str, content: Column, value: Column) -> DataFrame:
    """Rows (key, copies, differ): how many rows have the same content, and whether their values differ.

    Contents are counted before they meet their rows again, so many copies make no large group.
    """
    rows = df.select(key, F.sha2(content, 256).alias("_c"), value.alias("_v"))
    counts = rows.groupBy("_c").agg(F.count("*").alias("copies"), (F.min("_v") != F.max("_v")).alias("differ"))
    return rows.join(counts, "_c").select(key, "copies", "differ")
