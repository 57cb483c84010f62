"""Joins with a meaning of their own: pending work, comparators, theta and tolerance joins, linkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items that are not done yet."""
    return items.join(done.select(*keys), keys, "left_anti")


def changed(items: DataFrame, known: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Items without a known fingerprint or with another one."""
    old = known.select(key, F.col(fingerprint).alias("_old"))
    return items.join(old, key, "left").where(~F.col(fingerprint).eqNullSafe(F.col("_old"))).drop("_old")


def incident(edges: DataFrame, frontier: DataFrame, subject: str = "subject_id", obj: str = "object_id", key: str = "edge_id") -> DataFrame:
    """Edges with either end in the frontier (node): two semi joins, no disjunction."""
    a = edges.join(frontier.select(F.col("node").alias(subject)), subject, "left_semi")
    b = edges.join(frontier.select(F.col("node").alias(obj)), obj, "left_semi")
    return a.unionByName(b).dropDuplicates([key])


def null_safe(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Join on columns where null equals null."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in columns], *[c for c in right.columns if c not in columns])
    cond = [left[c].eqNullSafe(r[f"_r_{c}"]) for c in columns]
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in columns])


def in_order(rows: DataFrame, group: list[str], key: str, measures: list[str]) -> DataFrame:
    """Pairs (a, b) of a group with a at least b in every measure and above it in one; ordered within the group by an equi-join."""
    a = rows.select(*group, F.col(key).alias("a"), *[F.col(m).alias(f"a_{m}") for m in measures])
    b = rows.select(*group, F.col(key).alias("b"), *[F.col(m).alias(f"b_{m}") for m in measures])
    at_least = [F.col(f"a_{m}") >= F.col(f"b_{m}") for m in measures]
    above = [F.col(f"a_{m}") > F.col(f"b_{m}") for m in measures]
    out = a.join(b, group)
    for c in at_least:
        out = out.where(c)
    cond = above[0]
    for c in above[1:]:
        cond = cond | c
    return out.where(cond).select(*group, "a", "b")


def within_tolerance(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, keys: list[str], how: str = "left_anti") -> DataFrame:
    """Left rows with (or without) a right value within the tolerance.

    Values meet on cells of the tolerance's width, so the join is an equi-join whatever
    the tables' size; each right value stands in its own cell and both neighbours.
    """
    l = left.withColumn("_cell", F.floor(F.col(left_value) / tolerance))
    r = right.select(*keys, F.col(right_value).alias("_r"), F.explode(F.sequence(F.floor(F.col(right_value) / tolerance) - 1, F.floor(F.col(right_value) / tolerance) + 1)).alias("_cell"))
    cond = [l[k] == r[k] for k in keys] + [l["_cell"] == r["_cell"], F.abs(l[left_value] - r["_r"]) <= tolerance]
    return l.join(r, cond, how).drop("_cell")


def words_in_texts(names: DataFrame, texts: DataFrame, name: str, key: str, text: str) -> DataFrame:
    """Pairs (name, key) where a one-word name is a word of a text: words are exploded once, then an equi-join."""
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))).alias(name))
    return words.join(names.select(name).distinct(), name)


def not_registered(items: DataFrame, held: DataFrame, item_key: str, ids: Column) -> DataFrame:
    """Items none of whose identifiers is held (id)."""
    exploded = items.select(item_key, F.explode(ids).alias("id"))
    known = exploded.join(held.select("id").distinct(), "id", "left_semi").select(item_key).distinct()
    return items.join(known, item_key, "left_anti")


def own_by_protocol(numbers: DataFrame, least: int = 6) -> DataFrame:
    """Protocol numbers (owner, number) that are long enough and belong to one owner."""
    return numbers.where(F.length("number") >= least).groupBy("number").agg(F.min("owner").alias("owner"), F.max("owner").alias("_other")).where(F.col("owner") == F.col("_other")).drop("_other")


def sets_of_size(pairs: DataFrame, group: str, member: str, members: DataFrame, least: int, most: int) -> DataFrame:
    """Pairs (group, member) with known members, of groups that have between least and most of them."""
    inner = pairs.join(members.select(member).distinct(), member).dropDuplicates([group, member])
    sized = inner.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select(group)
    return inner.join(sized, group)


def outcome_rows(forecasts: DataFrame, rows: DataFrame, order: list[Column]) -> DataFrame:
    """Forecasts (key, trial, dose) with the first posted row of each role that settles them.

    rows has (source_id, study_id, role, dose, ...): a trial is named by either identifier, so
    two equi-joins meet; an active row must have the forecast's dose, a control has none.
    """
    f = forecasts.select("key", "trial", F.col("dose").alias("_dose"))
    parts = [f.join(rows, f["trial"] == rows[c]).drop("trial") for c in ("source_id", "study_id")]
    met = parts[0].unionByName(parts[1]).where((F.col("role") == "placebo") | F.col("dose").eqNullSafe(F.col("_dose"))).drop("_dose")
    w = Window.partitionBy("key", "role").orderBy(*order)
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def publications(references: DataFrame, citing: DataFrame) -> DataFrame:
    """Papers of trials (trial, paper, kind): what the registry refers to, and papers that cite the trial but are not among them."""
    own = references.select("trial", "paper").distinct().withColumn("kind", F.lit("reference"))
    more = citing.select("trial", "paper").distinct().join(own.select("trial", "paper"), ["trial", "paper"], "left_anti")
    return own.unionByName(more.withColumn("kind", F.lit("citing")))


def node_index(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names (file, name) with the index of their node: by its symbol, else by an alias; the index 0 is as good as any.

    nodes has (index, symbol, aliases).
    """
    key = lambda c: F.upper(F.trim(c))
    symbol = nodes.select(key(F.col("symbol")).alias("_k"), F.col("index").alias("_s"))
    alias = nodes.select(F.explode("aliases").alias("_a"), "index").groupBy(key(F.col("_a")).alias("_k")).agg(F.min("index").alias("_b"))
    return names.withColumn("_k", key(F.col("name"))).join(symbol, "_k", "left").join(alias, "_k", "left").withColumn("index", F.coalesce("_s", "_b")).drop("_k", "_s", "_b")


def first_found(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], value: str) -> DataFrame:
    """Left rows with a right value looked up by one identifier and, where that finds none, by the next.

    on has (kind of the right row, left column); right has (kind, id, value).
    """
    out = left
    for i, (kind, column) in enumerate(on):
        out = out.join(right.where(F.col("kind") == kind).select(F.col("id").alias(column), F.col(value).alias(f"_v{i}")), column, "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in range(len(on))])).drop(*[f"_v{i}" for i in range(len(on))])
