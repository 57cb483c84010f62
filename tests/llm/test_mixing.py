"""The mix by brute force: targets, the splitting tree with exact draws, runs on permuted lines."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def draw(n_all, n_good, n_drawn, u):
    """The multivariate tree's single draw by exact counting: the number of good ones at u."""
    lo, hi = max(0, n_drawn - (n_all - n_good)), min(n_good, n_drawn)
    below, total = 0, math.comb(n_all, n_drawn)
    for k in range(lo, hi + 1):
        below += math.comb(n_good, k) * math.comb(n_all - n_good, n_drawn - k)
        if Fraction(below, total) > u:
            return k
    return hi


def split(spark, quotas, shards, seed=mixing.SEED):
    """The tree in plain Python, with the same uniform numbers."""
    nodes = {0: list(quotas)}
    for level in range(int(math.log2(shards))):
        asked = [(level, s, i) for s in nodes for i in range(len(quotas))]
        df = spark.createDataFrame(asked, "level int, shard long, i int")
        us = {(r.shard, r.i): r.u for r in df.select("shard", "i", F.expr(f"(pmod(xxhash64({seed}, level, shard, 0L, i), 4503599627370496L) + 0.5D) / 4503599627370496D").alias("u")).collect()}
        out = {}
        for s, q in nodes.items():
            rest, todo, left = sum(q), sum(q) // 2, []
            for i, x in enumerate(q):
                left.append(draw(rest, x, todo, Fraction(us[s, i])))
                rest, todo = rest - x, todo - left[-1]
            out |= {2 * s: left, 2 * s + 1: [a - b for a, b in zip(q, left)]}
        nodes = out
    return nodes


def quota_frame(spark, *groups):
    return spark.createDataFrame(list(enumerate(groups)), "g long, quota array<long>")


@pytest.mark.parametrize("quotas", [[13, 0, 7, 22], [1], [0, 0], [40, 40, 1]])
def test_tree_by_brute_force(spark, quotas):
    got = {r.shard: r.quota for r in mixing.split_quotas(quota_frame(spark, quotas), 8).collect()}
    assert got == split(spark, quotas, 8)


def test_many_sources_split_in_groups(spark):
    groups = [[5, 0, 9], [100, 3, 3], [0, 1, 20]]
    rows = mixing.split_quotas(quota_frame(spark, *groups), 8).collect()
    shards, by_source = Counter(), defaultdict(lambda: [0, 0, 0])
    for r in rows:
        shards[r.shard] += sum(r.quota)
        assert min(r.quota) >= 0
        by_source[r.g] = [a + b for a, b in zip(by_source[r.g], r.quota)]
    assert [by_source[g] for g in range(3)] == groups and set(shards.values()) <= {17, 18}


@pytest.fixture(scope="module")
def docs(spark):
    text = F.repeat(F.lit("w "), (F.col("id") * 7 % 41).cast("int"))
    source = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 11 == 5, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 4))
    rows = spark.range(700).select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"))
    return rows.union(rows.where("doc_id IN (40, 41)")).union(spark.createDataFrame([(900, "long " * 3000, "a"), (901, "long " * 3000, None)] + [(902, "twin x", "s1")] * 50, rows.schema))


def test_mix_by_brute_force(spark, docs):
    """Every document's words and their shards, from the line of its source and the runs of the tree."""
    shards = 8
    got = Counter((r.doc_id, r.size, r.taken, r.s) for r in mixing.mix(docs, shards=shards).select("doc_id", "size", mixing.words_taken().alias("taken"), F.transform("draws", lambda d: F.array(d["copy"].cast("long"), d["shard"], d["words"])).cast("string").alias("s")).collect())
    rows = [(r.sk, r.leaf, r.spot, r.doc_id, r.size) for r in mixing.sized(docs).withColumn("leaf", F.shiftrightunsigned("spot", 62)).collect()]  # 4 leaves for 754 documents
    sources = sorted({r[0] for r in rows})
    plan = {r.sk: r for r in mixing.targets(docs.sparkSession.createDataFrame([(s, sum(r[4] for r in rows if r[0] == s)) for s in sources], "sk string, source_size long")).collect()}
    goals = {s: math.floor(plan[s].target + 0.5) for s in sources}
    block = max(1, -(-sum(goals.values()) // mixing.BLOCKS))
    quotas = split(spark, [-(-goals[s] // block) for s in sources], shards)
    want = Counter()
    for i, s in enumerate(sources):
        runs, at = [], 0
        for shard in range(shards):
            runs.append((shard, at, min(at + quotas[shard][i] * block, goals[s])))
            at += quotas[shard][i] * block
        line = sorted(r for r in rows if r[0] == s)
        total, at = sum(r[4] for r in line), 0
        for _, _, _, doc_id, size in line:
            drawn = [[copy, shard, min(hi, b + size) - max(lo, b)] for copy, b in ((0, at), (1, at + total)) for shard, lo, hi in runs if lo < b + size and hi > b and size]
            want[doc_id, size, sum(d[2] for d in drawn), str(drawn)] += 1
            at += size
        assert total == plan[s].source_size
    assert got == want


def test_a_wrong_tree_gives_a_wrong_mix(spark, docs, monkeypatch):
    def op8():
        m = mixing.mix(docs, shards=8)
        return m.select("doc_id", mixing.words_taken().alias("taken"), F.col("draws").cast("string").alias("s")).collect()

    right = op8()
    real = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, seed: q.select(F.lit(0).cast("long").alias("shard"), "g", "quota"))
    assert Counter(r.s for r in op8()) != Counter(r.s for r in right)
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, seed: real(q, n, seed).where("shard < 5"))
    assert sum(r.taken for r in op8()) < 0.7 * sum(r.taken for r in right)
