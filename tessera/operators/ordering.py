"""Running aggregates and ranks along an order that no single task holds.

Rows are range-partitioned by the order; each partition runs its own window, and what the
earlier partitions hold is carried in from one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import reliable


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums and minima (current row included) of each key's rows along the order.

    The order must be total within a key.
    """
    sums, mins = sums or {}, mins or {}
    by = [F.col(k) for k in keys] + order
    rows = df.withColumns({f"_v_{n}": c for n, c in (sums | mins).items()})
    rows = reliable(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_o_{n}": F.sum(f"_v_{n}").over(own) for n in sums} | {f"_o_{n}": F.min(f"_v_{n}").over(own) for n in mins})
    # One row a partition and key: as many as partitions and keys together.
    parts = rows.groupBy("_range", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums], *[F.min(f"_v_{n}").alias(f"_t_{n}") for n in mins])
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("_range", *keys, *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums], *[F.min(f"_t_{n}").over(before).alias(f"_c_{n}") for n in mins])
    renamed = carry.select(F.col("_range").alias("_carry_range"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_c_{n}" for n in sums | mins])
    cond = rows["_range"] == renamed["_carry_range"]
    for k in keys:
        cond = cond & rows[k].eqNullSafe(renamed[f"_k_{k}"])
    both = rows.join(renamed, cond)
    out = {n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.col(f"_o_{n}") for n in sums} | {n: F.least(F.col(f"_c_{n}"), F.col(f"_o_{n}")) for n in mins}
    return both.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers from 1 along a total order over the whole table."""
    return running(df, [], order, sums={name: F.lit(1).cast("long")})


def adjusted_p(df: DataFrame, p: str, key: str, family: list[str]) -> DataFrame:
    """Benjamini-Hochberg for families of any size: column ``fdr``."""
    up = running(df, family, [F.col(p), F.col(key)], sums={"_rank": F.lit(1).cast("long")})
    size = df.groupBy(*family).agg(F.count("*").alias("_m"))
    sized = up.join(size, family) if family else up.withColumn("_m", size.scalar())
    down = running(sized, family, [F.desc("_rank")], mins={"_least": F.col(p) * F.col("_m") / F.col("_rank")})
    return down.select(*df.columns, F.least(F.lit(1.0), "_least").alias("fdr"))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the rank of value within its keys, ties at their mean: running counts over distinct values, joined back."""
    per = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = running(per, keys, [F.col(value)], sums={"_upto": F.col("_n")})
    return df.join(upto.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name)), [*keys, value])
