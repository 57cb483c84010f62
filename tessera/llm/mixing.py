"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Everything here is DataFrame and SQL expressions.

1. Each source's documents lie on a line in the order of a hash (a fixed permutation);
   a second round over the documents follows the first on the same line.  A document's
   place on the line is the sum of three running sums (groups of leaves, leaves of a
   group, documents of a leaf), each over a bounded group, so no source is ever in one
   task.
2. Targets fill up by weight and stop at twice a source's size.
3. Targets are cut into blocks of equal size.  A binary tree over the output shards
   splits the block quotas of all sources exactly in halves: each node's left child draws
   from the sources like cards from one deck (multivariate hypergeometric, source by
   source, by inversion of the exact distribution), the right child gets the rest.  So
   every shard has the same number of blocks, every quota is used up exactly, and the
   draw is the one a uniform shuffle of all blocks would give.  More sources than ``FAN``
   are split in two steps by the same draw: among groups of sources, then within each.
4. A shard's quota of a source is the next run of blocks on that source's permuted line:
   runs are disjoint.  What the mix takes of a document are the words that runs cover, shard
   by shard; a document that reaches over the end of a run is drawn by both shards, a part
   each.  Within a shard, ``place`` is a pseudo-random order.

The last document of a target may be taken in part, so a source's words are its target
rounded to a word.  Nothing depends on partitions or on the time: reruns agree.

Defined results: a null source is a source of its own, last in order; texts without words
(null, empty) have size 0 and are taken 0 times; a very long text is one document of its
size, split among shards like any; repeated rows are documents of their own, counted before
they are placed, one after the other, so that a row repeated without end makes no large
group; with no words at all, all targets are 0; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import reliable


WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
LEAF_ROWS = 256
BLOCKS = 1 << 20
SHARD_WORDS = 1 << 22
FAN = 1024
SEED = 8


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, sk, size, spot): sk orders sources by code point, null last."""
    text = F.col("text").cast("string")
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("sk"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text).alias("spot"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows (sk, sid, source_size, target) from (sk, source_size); one row a source."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.row_number().over(Window.orderBy("sk")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    rows = sizes.select("sk", "source_size", nth.alias("sid"), weight.alias("w")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    filled = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    # The level if all sources that fill up earlier are at their caps.
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumns({"level": level, "turn": F.row_number().over(filled)})
    free = F.col("cap") >= F.col("w") * F.col("level")
    final = F.min(F.when(free, F.struct("turn", "level"))).over(everything)["level"]
    return rows.select("sk", "sid", "source_size", F.least("cap", F.coalesce(F.col("w") * final, F.col("cap"))).alias("target"))


def _let(**values: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def hypergeometric(n_all: str, n_good: str, n_drawn: str, u: str) -> str:
    """SQL: the number of good ones among n_drawn of n_all, by inversion at u.

    The support is cut nine standard deviations from the mean, where it holds less than
    1e-17 of the probability; the weights follow from their ratios.
    """
    given = _let(every=f"cast({n_all} as double)", good=f"cast({n_good} as double)", drawn=f"cast({n_drawn} as double)", u=u)
    mean = "(g.drawn * g.good / greatest(g.every, 1D))"
    sd = f"sqrt({mean} * (1 - g.good / greatest(g.every, 1D)) * (g.every - g.drawn) / greatest(g.every - 1, 1D))"
    lo = f"greatest(0D, g.drawn - (g.every - g.good), floor({mean} - 9 * {sd} - 1))"
    hi = f"least(g.drawn, g.good, ceil({mean} + 9 * {sd} + 1))"
    ratio = "((b.g.good - k) * (b.g.drawn - k) / ((k + 1) * greatest(b.g.every - b.g.good - b.g.drawn + k + 1, 1D)))"
    steps = "sequence(cast(b.lo as bigint), cast(b.hi as bigint))"
    total = f"aggregate({steps}, named_struct('w', 1D, 's', 0D), (a, k) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w), a -> a.s)"
    below = f"aggregate({steps}, named_struct('w', 1D, 's', 0D, 'c', 0L), (a, k) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w, 'c', a.c + if(a.s + a.w <= b.g.u * b.total, 1L, 0L)), a -> a.c)"
    bounded = f"transform(array({given}), g -> named_struct('g', g, 'lo', {lo}, 'hi', {hi}))[0]"
    summed = f"transform(array({bounded}), b -> named_struct('g', b.g, 'lo', b.lo, 'hi', b.hi, 'total', {total}))[0]"
    return f"transform(array({summed}), b -> cast(least(b.hi, b.lo + {below}) as bigint))[0]"


def _left(quota: str, total: str, drawn: str, salt: str) -> str:
    """SQL: what a left child takes of each entry of an array, if it draws ``drawn`` of ``total`` in all."""
    u = f"(pmod(xxhash64({salt}, i), 4503599627370496L) + 0.5D) / 4503599627370496D"
    got = hypergeometric("s.rest", f"{quota}[i]", "s.draw", u)
    return (
        f"aggregate(sequence(0, size({quota}) - 1), named_struct('rest', {total}, 'draw', {drawn}, 'out', cast(array() as array<bigint>)), "
        f"(s, i) -> transform(array({got}), d -> named_struct('rest', s.rest - {quota}[i], 'draw', s.draw - d, 'out', concat(s.out, array(d))))[0], s -> s.out)"
    )


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Rows (shard, g, quota) from (g, quota): arrays of blocks of up to FAN sources; g numbers them, shards is a power of two."""
    tree = quotas.select(F.lit(0).cast("long").alias("shard"), "g", "quota")
    grouped = quotas.limit(2).count() > 1
    for level in range(int(math.log2(shards))):
        tree = tree.withColumn("total", F.aggregate("quota", F.lit(0).cast("long"), lambda a, q: a + q))
        if grouped:
            tree = reliable(tree)
            sums = tree.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "total"))), lambda x: x["total"]).alias("sums")).withColumn("all", F.aggregate("sums", F.lit(0).cast("long"), lambda a, q: a + q))
            draws = sums.select("shard", F.expr("posexplode(" + _left("sums", "all", "all div 2", f"{seed}, 'groups', {level}, shard") + ") as (g, draw)"))
            tree = tree.join(draws.withColumn("g", F.col("g").cast("long")), ["shard", "g"])
        else:
            tree = tree.withColumn("draw", F.expr("total div 2"))
        tree = tree.select("shard", "g", "quota", F.expr(_left("quota", "total", "draw", f"{seed}, {level}, shard, g")).alias("left"))
        halves = F.array(F.struct((2 * F.col("shard")).alias("shard"), F.col("left").alias("quota")), F.struct((2 * F.col("shard") + 1).alias("shard"), F.zip_with("quota", "left", lambda q, x: q - x).alias("quota")))
        tree = tree.select("g", F.explode(halves).alias("half")).select("half.shard", "g", "half.quota")
    return tree


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, draws), one for each row of docs.

    ``draws`` lists what the shards draw of it: (copy, words, shard, place).
    """
    if most != 2:
        raise ValueError("the line has two rounds: most is 2")
    rows = sized(docs, seed).groupBy("doc_id", "sk", "size", "spot").agg(F.count("*").alias("copies"))  # repeated rows once
    rows = reliable(rows)
    n = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF_ROWS))))
    leaf = F.shiftrightunsigned("spot", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("leaf", leaf)
    leaves = reliable(rows.groupBy("sk", "leaf").agg(F.sum(F.col("size") * F.col("copies")).alias("words")))
    plan = reliable(targets(leaves.groupBy("sk").agg(F.sum("words").alias("source_size")), weights, share, most).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long")))
    total = plan.agg(F.sum("goal")).first()[0] or 0
    if shards is None:
        shards = max(4, 1 << math.ceil(math.log2(max(1, total / SHARD_WORDS))))
    block = max(1, -(-total // max(BLOCKS, 64 * shards)))
    # The tree: block quotas of all sources (one entry a source) split among the shards.
    entries = plan.select(F.expr(f"sid div {FAN}").alias("g"), "sid", F.ceil(F.col("goal") / block).cast("long").alias("b"))
    quota = entries.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("sid", "b"))), lambda x: x["b"]).alias("quota"))
    runs = split_quotas(quota, shards, seed).select("shard", "g", F.posexplode("quota").alias("nth", "blocks")).select("shard", (F.col("g") * FAN + F.col("nth")).alias("sid"), "blocks")
    upto = F.sum("blocks").over(Window.partitionBy("sid").orderBy("shard"))
    runs = runs.withColumns({"hi": upto * block, "lo": (upto - F.col("blocks")) * block}).where("blocks > 0")
    # Places of leaves on their source's line, in two steps of bounded groups.
    half = bits // 2
    leaves = leaves.withColumn("bough", F.shiftright("leaf", half))
    boughs = leaves.groupBy("sk", "bough").agg(F.sum("words").alias("bough_words"))
    boughs = boughs.select("sk", "bough", (F.sum("bough_words").over(Window.partitionBy("sk").orderBy("bough")) - F.col("bough_words")).alias("bough_at"))
    within = F.sum("words").over(Window.partitionBy("sk", "bough").orderBy("leaf")) - F.col("words")
    leaves = leaves.withColumn("leaf_at", within).join(boughs, ["sk", "bough"]).join(plan, "sk")
    leaves = leaves.withColumns({"at": F.col("leaf_at") + F.col("bough_at"), "cell": F.greatest(F.ceil(F.col("goal") / shards), F.lit(1)).cast("long")})
    # Which runs a leaf's words meet: an equi-join on the cells of a grid over the line.
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / F.col("cell")), F.floor(b / F.col("cell"))))
    grid = runs.join(plan.select("sid", "goal"), "sid").withColumn("cell", F.greatest(F.ceil(F.col("goal") / shards), F.lit(1)).cast("long"))
    grid = grid.withColumn("hi", F.least("hi", "goal")).where("lo < hi")
    grid = grid.select("sid", "shard", "lo", "hi", cells(F.col("lo"), F.col("hi") - 1).alias("spot"))
    ends = F.explode(F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("words") - 1).alias("b")), F.struct((F.col("at") + F.col("source_size")).alias("a"), (F.col("at") + F.col("source_size") + F.col("words") - 1).alias("b"))))
    pieces = leaves.where("words > 0").select("sk", "leaf", "sid", "cell", "goal", ends.alias("x")).where("x.a < goal")
    pieces = pieces.select("sk", "leaf", "sid", "x", cells(F.col("x.a"), F.least("x.b", F.col("goal") - 1)).alias("spot"))
    met = pieces.join(grid, ["sid", "spot"]).where("lo <= x.b AND hi > x.a")
    met = met.groupBy("sk", "leaf").agg(F.array_sort(F.collect_set(F.struct("lo", "hi", "shard"))).alias("runs"))
    leaves = leaves.select("sk", "leaf", "at", "source_size", "target", "goal").join(met, ["sk", "leaf"], "left")
    # Documents: their place in the leaf, then the words of either round that lie before the goal.
    order = Window.partitionBy("sk", "leaf").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.col("size") * F.col("copies")
    placed = rows.withColumn("own", F.sum(words).over(order) - words).join(leaves, ["sk", "leaf"])
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = placed.withColumn("at", F.col("at") + F.col("own") + F.col("nth") * F.col("size"))
    placed = placed.withColumn("spot", F.when(F.col("nth") == 0, F.col("spot")).otherwise(F.xxhash64("spot", "nth")))

    def drawn(copy: int) -> Column:
        begin = F.col("at") + copy * F.col("source_size")
        end = begin + F.col("size")
        place = F.xxhash64(F.lit(seed + 1), "spot", F.lit(copy))
        return F.transform(
            F.filter("runs", lambda r: (r["lo"] < end) & (r["hi"] > begin)),
            lambda r: F.struct(F.lit(copy).alias("copy"), (F.least(r["hi"], end) - F.greatest(r["lo"], begin)).alias("words"), r["shard"].alias("shard"), place.alias("place")),
        )

    none = F.array().cast("array<struct<copy:int,words:bigint,shard:bigint,place:bigint>>")
    draws = F.when((F.col("size") > 0) & F.col("runs").isNotNull(), F.concat(drawn(0), drawn(1))).otherwise(none)
    source = F.when(F.col("sk") != "1", F.expr("substring(sk, 2)"))
    return placed.select("doc_id", source.alias("source"), "size", "source_size", "target", draws.alias("draws"))


def words_taken() -> Column:
    return F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    parts = F.transform("draws", lambda d: F.concat_ws(":", d["shard"].cast("string"), d["words"].cast("string")))
    return mixed.select("doc_id", "size", "source_size", "target", words_taken().alias("taken"), F.array_join(parts, ",").alias("shards"))
