"""Candidate component scores, their sum and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points of a predicate at full confidence, points of a stage rank.
PREDICATE_POINTS = {"treats": 25, "investigates": 15, "tested_in": 8, "inhibits": 8, "targets": 8}
ACTIVE_STATUSES = ("RECRUITING", "ACTIVE_NOT_RECRUITING", "AUTHORISED")


def graph_points(edges: DataFrame, key: str) -> DataFrame:
    """Rows (key, graph): points of each key's distinct extracted edges, 40 at most."""
    table = F.create_map(*[F.lit(x) for p in PREDICATE_POINTS.items() for x in p])
    points = (F.coalesce(F.try_element_at(table, F.lower("predicate")), F.lit(0)) * F.col("confidence")).cast("int")
    extracted = edges.where("extraction_method <> 'structured'").dropDuplicates([key, "edge_id"])
    return extracted.groupBy(key).agg(F.least(F.sum(points), F.lit(40)).alias("graph"))


def trial_points(rank: Column, has_results: Column, status: Column) -> Column:
    """Aggregate over a key's trials: best phase, results, activity, breadth (0 to 35)."""
    best = F.max(rank)
    phase = F.when(best >= 6, 15).when(best >= 4, 10).when(best > 0, 3).otherwise(0)
    results = F.when(F.bool_or(has_results & (rank >= 4)), 10).when(F.bool_or(has_results), 5).otherwise(0)
    active = F.when(F.bool_or(F.upper(status).isin(*ACTIVE_STATUSES)), 5).otherwise(0)
    return phase + results + active + F.least(F.count("*") - 1, F.lit(5))


def literature_points(n: Column) -> Column:
    return F.least(n * 4, F.lit(20))


def strength(score: Column) -> Column:
    return F.when(score >= 70, "strong").when(score >= 45, "moderate").when(score >= 25, "weak").otherwise("speculative")
