"""Decontamination in one block and in many, against brute force; a large benchmark within its memory."""

from __future__ import annotations

import random
import re
import resource
from collections import Counter

import pyarrow as pa
import pytest

from tessera.llm import decontam

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, window):
    out = Counter()
    grams = {}
    for item, text in bench:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if item is not None and m else 0):
            grams.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for m in {len(g) for g in grams}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in grams:
                    hit |= set(range(i, i + m))
                    items |= grams[tuple(w[i : i + m])]
        out[doc, len(w), tuple(sorted(hit)), tuple(sorted(items))] += 1
    return out


@pytest.mark.parametrize("block_words", [1 << 20, 60, 7])
@pytest.mark.parametrize("window", [3, 10])
def test_blocks_by_brute_force(spark, block_words, window):
    rng = random.Random(window)
    make = lambda n: " ".join(rng.choice(["a", "B", "c1", "é", "dd", "-"]) for _ in range(n))
    bench = [(i, make(rng.randrange(1, 40))) for i in range(12)] + [(50, None), (51, "?!"), (None, "a a a"), (3, "again a B"), (60, make(200))]
    docs = [(i, make(rng.randrange(0, 60))) for i in range(60)] + [(90, bench[0][1]), (90, "x " + bench[4][1] + " y"), (90, bench[0][1]), (None, bench[16][1]), (91, None), (92, make(5) + bench[16][1][:150])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'p' AS hits", "'q' AS n_words")
    b = spark.createDataFrame(bench, "item_id long, text string")
    marked = decontam.mark_contamination(spark, d, b, window, block_words=block_words).collect()
    got = Counter((r.doc_id, r.n_words, tuple(x for a, z in zip(r.hits[::2], r.hits[1::2]) for x in range(a, z)), tuple(r["items"])) for r in marked)
    assert got == brute(docs, bench, window)
    if block_words == 7:
        assert decontam.blocks(b, window, block_words)[0] > 10


def test_spans_go_alike_in_one_block_and_in_many(spark):
    bench = spark.createDataFrame([(i, f"alpha{i} beta gamma delta") for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"Keep — ALPHA{i} beta, gamma delta! and this", "x") for i in range(40)] + [(99, None, "y")], "doc_id long, text string, dk string")
    ways = [sorted(map(tuple, decontam.mark_contamination(spark, docs, bench, 4, keep_text=True, keep=("dk",), block_words=n).select("doc_id", "clean_text", "dk").collect()), key=str) for n in (1 << 20, 20)]
    assert ways[0] == ways[1] and (3, "Keep — ! and this", "x") in ways[0] and (99, None, "y") in ways[0]


def test_memory_of_a_block():
    """A whole block takes a small part of the driver's memory."""
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(4096)) for _ in range(256)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    block = decontam.Windows([str(i) for i in range(256)], texts, 10)
    assert len(block.tables[10][1]) > 1_000_000
    letters, offsets, counts = decontam.split_words(pa.array(texts[:3]), decontam.ALNUM)
    assert block.scan(letters, offsets, counts)[0].all()
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 450
