"""An append-only ledger of tests and sealed records; uniqueness is checked before anything is added."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import ranked


def canonical(record: dict[str, Any]) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), default=str)


def sealed(record: dict[str, Any]) -> dict[str, Any]:
    """The record with the SHA-256 of its canonical JSON."""
    body = {k: v for k, v in record.items() if k != "sha256"}
    return body | {"sha256": hashlib.sha256(canonical(body).encode()).hexdigest()}


def verify_seal(record: dict[str, Any]) -> bool:
    return sealed(record)["sha256"] == record.get("sha256")


def new_tests(tests: DataFrame, candidates: DataFrame, key: str = "unit_key", order: str = "proposed_at") -> DataFrame:
    """Candidates whose unit was never spent, once each, with the next test numbers."""
    fresh = candidates.join(tests.select(key), key, "left_anti")
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    last = tests.agg(F.coalesce(F.max("t"), F.lit(0))).scalar()
    return ranked(first, [F.col(order), F.col(key)], "_t").withColumn("t", F.col("_t") + last).drop("_t")


def conflicts(rows: DataFrame, unique: list[str]) -> DataFrame:
    """Values that break a uniqueness rule: rows (rule, value, n)."""
    pairs = F.array(*[F.struct(F.lit(u).alias("rule"), F.col(u).cast("string").alias("value")) for u in unique])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.rule", "x.value").agg(F.count("*").alias("n")).where("n > 1")


def resolved(forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Forecasts with the outcomes that settle them; those stay as they are that are resolved or without one."""
    new = outcomes.select("sha256", F.col("resolution").alias("_resolution"))
    both = forecasts.join(new, "sha256", "left")
    now = (F.col("status") == "pending") & F.col("_resolution").isNotNull()
    return both.withColumns({"status": F.when(now, "resolved").otherwise(F.col("status")), "resolution": F.when(now, F.col("_resolution")).otherwise(F.col("resolution"))}).drop("_resolution")
