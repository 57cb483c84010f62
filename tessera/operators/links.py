"""Link prediction over node vectors: ranks of held-out links, top predictions, and the screen built on them.

Queries are a stated set and meet all nodes in blocks: a block of query vectors is a matrix
that every task multiplies with its nodes.  Known links are a table and meet by keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vector import dot

BLOCK = 256


def _counts_above(nodes: DataFrame, queries: list) -> DataFrame:
    """Rows (query, above, above_typed): nodes that score over a query's target, of any kind and of the target's."""
    ids = [q.query for q in queries]
    vectors = np.array([q.vector for q in queries], float)
    marks, kinds = np.array([q.score for q in queries]), np.array([q.kind for q in queries], object)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column("vector").to_pylist(), float)
            over = v @ vectors.T > marks + 1e-12 * np.abs(marks)
            typed = over & (np.array(batch.column("kind").to_pylist(), object)[:, None] == kinds)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(over.sum(axis=0)), pa.array(typed.sum(axis=0))], ["query", "above", "above_typed"])

    parts = nodes.select("kind", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "query long, above long, above_typed long")
    return parts.groupBy("query").agg(F.sum("above").alias("above"), F.sum("above_typed").alias("above_typed"))


def link_ranks(nodes: DataFrame, tests: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (query, raw, filtered, typed): the target's rank among all nodes, without other known answers, and among its kind.

    nodes has (node, kind, vector), tests (query, vector, target), known (query, node).
    """
    scored = tests.join(nodes.select(F.col("node").alias("target"), "kind", F.col("vector").alias("tv")), "target")
    scored = scored.select("query", "vector", "target", "kind", dot(F.col("vector"), F.col("tv")).alias("score"))
    asked = scored.orderBy("query").collect()  # the stated set of held-out links
    counts = [_counts_above(nodes, asked[i : i + BLOCK]) for i in range(0, len(asked), BLOCK)]
    above = counts[0]
    for part in counts[1:]:
        above = above.unionByName(part)
    others = known.distinct().join(scored, "query").where("node <> target").join(nodes.select("node", F.col("kind").alias("nk"), F.col("vector").alias("nv")), "node")
    better = others.where(dot(F.col("vector"), F.col("nv")) > F.col("score") + 1e-12 * F.abs("score"))
    less = better.groupBy("query").agg(F.count("*").alias("k"), F.count_if(F.col("nk") == F.col("kind")).alias("kt"))
    rows = above.join(less, "query", "left")
    cut = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("query", (F.col("above") + 1).alias("raw"), (F.col("above") - cut("k") + 1).alias("filtered"), (F.col("above_typed") - cut("kt") + 1).alias("typed"))


def rank_metrics(ranks: DataFrame, rank: str, by: list[str] | None = None, hits: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Mean reciprocal rank, mean and median rank and the shares within the first few, over all links or for each relation."""
    at = [F.avg((F.col(rank) <= k).cast("double")).alias(f"hits_{k}") for k in hits]
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(1.0 / F.col(rank)).alias("mrr"), F.avg(rank).alias("mean_rank"), F.median(rank).alias("median_rank"), *at)


def top_links(nodes: DataFrame, vector: Column, k: int, kind: str | int | None = None, but: tuple[int, ...] = ()) -> DataFrame:
    """The k nodes that score best with a query vector, of one kind or of any, without the query's own node."""
    rows = nodes.where(F.col("kind") == kind) if kind is not None else nodes
    rows = rows.where(~F.col("node").isin(*but)) if but else rows
    scored = rows.select("node", "kind", dot(vector, F.col("vector")).alias("score"))
    best = scored.orderBy(F.desc("score"), "node").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "node")).alias("rank"), "node", "kind", "score", (1 / (1 + F.exp(-F.col("score")))).alias("probability"))


def distmult_query(known: Column, relation: Column) -> Column:
    """The vector that a missing end is scored with; the form is symmetric, so heads and tails are asked alike."""
    return F.zip_with(known, relation, lambda a, b: a * b)


def screen(scores: DataFrame, verified: DataFrame, overall: DataFrame, percentile: float = 0.88, floor: float = 0.5, bonus: float = 0.35, lift: float = 2.0) -> DataFrame:
    """Drugs ranked by their affinity to a set of targets: rows (rank, drug, score, matches).

    scores has (drug, target, score), verified (drug, target), overall (drug, name, treats,
    causes, adjustment).  A target's own percentile is the bar that a predicted match must
    reach, so hub targets do not match everything; a verified link always matches, first.  A
    drug's score is the mean of its three best targets with a bonus for up to three verified
    ones, its net effect on the disease, and its class's adjustment.  One row a name stays.
    """
    bar = scores.groupBy("target").agg(F.greatest(F.percentile("score", F.lit(percentile)), F.lit(floor)).alias("bar"))
    seen = verified.distinct().withColumn("sure", F.lit(True))
    rows = scores.join(bar, "target").join(seen, ["drug", "target"], "left").withColumn("sure", F.coalesce("sure", F.lit(False)))
    label = F.struct((-F.col("score") - F.when(F.col("sure"), lift).otherwise(0.0)).alias("s"), F.concat(F.col("target").cast("string"), F.when(F.col("sure"), "*").otherwise("")).alias("t"))
    per = rows.groupBy("drug").agg(
        F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 3).alias("best"), F.count_if("sure").alias("sure"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("sure") | (F.col("score") >= F.col("bar")), label))), lambda x: x["t"]), 1, 5).alias("matches"),
    )
    mean = F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.size("best")
    net = F.col("treats") - 0.75 * F.greatest(F.lit(0.0), F.col("causes"))
    told = per.join(overall, "drug").withColumn("score", 0.6 * (mean + bonus * F.least("sure", F.lit(3))) + 0.4 * net + F.col("adjustment"))
    once = told.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "drug"))).where("_n = 1")
    from tessera.operators.ordering import ranked

    return ranked(once.select("drug", "name", "score", "matches"), [F.desc("score"), F.col("drug")])


def combinations(left: DataFrame, right: DataFrame, top: int, most: int) -> DataFrame:
    """Pairs of the best of two screens (drug, name, class, score): the mean of both scores, of different names and classes.

    Each name stands in at most ``most`` pairs, taken in score order; both lists are cut to
    ``top`` drugs, so there are no more than top * top pairs.
    """
    cut = lambda df, side: df.orderBy(F.desc("score"), "drug").limit(top).select(*[F.col(c).alias(f"{side}_{c}") for c in ("drug", "name", "class", "score")])
    block = cut(right, "r").agg(F.collect_list(F.struct("r_drug", "r_name", "r_class", "r_score")).alias("others"))
    pairs = cut(left, "l").withColumn("o", F.explode(block.scalar())).select("l_drug", "l_name", "l_class", "l_score", "o.*")
    pairs = pairs.where("l_name <> r_name AND l_class <> r_class").withColumn("score", (F.col("l_score") + F.col("r_score")) / 2)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "l_drug", "r_drug", "l_name", "r_name")))
    uses = lambda acc, name: F.coalesce(F.try_element_at(acc["used"], name), F.lit(0))
    empty = F.create_map().cast("map<string,int>")
    state = F.struct(empty.alias("used"), F.array().cast("array<struct<l_drug:bigint,r_drug:bigint,score:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a, b = F.concat(F.lit("l:"), x["l_name"]), F.concat(F.lit("r:"), x["r_name"])
        fits = (uses(acc, a) < most) & (uses(acc, b) < most)
        after = F.map_concat(F.map_filter(acc["used"], lambda k, _: (k != a) & (k != b)), F.create_map(a, uses(acc, a) + 1, b, uses(acc, b) + 1))
        row = F.struct(x["l_drug"].cast("bigint").alias("l_drug"), x["r_drug"].cast("bigint").alias("r_drug"), (-x["s"]).alias("score"))
        return F.struct(F.when(fits, after).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    return pairs.agg(F.aggregate(rows, state, step, lambda a: a["out"]).alias("out")).select(F.posexplode("out").alias("n", "p")).select((F.col("n") + 1).alias("rank"), "p.*")
