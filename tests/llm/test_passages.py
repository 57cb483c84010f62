"""Line templates: fields at any place, passages in a few documents, short lines, ties."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest
from brute_lines import expected

from tessera.llm.linededup import dedup_lines, op6_line_dedup


def line(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))


@pytest.mark.parametrize("times", [2, 3, 4])
def test_planted_passages(spark, times):
    rng = random.Random(times)
    long, edge, short = line(rng, 60), line(rng, 50), line(rng, 49)
    texts = ["\n".join([line(rng, 30), long, edge, short, line(rng, 30)]) for _ in range(times)]
    texts += [line(rng, 30) + "\n" + long.upper(), texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text.split("\n") for r in dedup_lines(docs).collect()}
    assert got[0] == texts[0].split("\n") and got[times] == texts[times].split("\n")[:1]
    for i in range(1, times):
        assert got[i] == [x for x in texts[i].split("\n") if x not in (long, edge)]
    assert got == {r.doc_id: r.text.split("\n") for r in corpus_pipeline.lines(spark, docs, "").collect()}


def test_driver_table(spark, sf_dir):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert expected(docs) == Counter(tuple(r) for r in op6_line_dedup(spark, sf_dir).collect())


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


FORMS = [
    "Posted by {0} {1} on monday at the usual place and hour",  # two words side by side
    "Copyright holder {0} {1} grants the right to copy this notice {2}",  # at an even, an odd and the last place
    "Posted here by {0} today",  # few tokens
    "Page {3} of {0} in volume {3} of the {1} collected works of {2}",  # fields with and without digits
]


@pytest.mark.parametrize("form", FORMS)
def test_fields_anywhere(spark, form):
    """Lines that differ in their fields share a template; five texts make it recur, four don't."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    for n in (4, 5, 40):
        texts = [f"{line(rng, 30)}\n{form.format(word(), word(), word(), rng.randrange(99))}\n{line(rng, 12)}" for _ in range(n)]
        got = {r.doc_id: r.text.split("\n") for r in dedup_lines(frame(spark, texts)).collect()}
        assert got[0] == texts[0].split("\n")
        for i in range(1, n):
            mine = texts[i].split("\n")
            assert got[i] == (mine if n < 5 else [mine[0], mine[2]])


def test_clean_lines_stay(spark):
    """Prose that shares its first words and its length, but not most of its places, is no template."""
    rng = random.Random(4)
    texts = ["\n".join("in the " + line(rng, 8) for _ in range(3)) + "\nin the middle of " + line(rng, 6) for _ in range(60)]
    assert {r.doc_id: r.text for r in dedup_lines(frame(spark, texts)).collect()} == dict(enumerate(texts))


def test_short_lines_recur_at_their_own_floor(spark):
    rng = random.Random(5)
    for n in (19, 20):
        texts = [f"{line(rng, 20)}\nAll rights reserved.\n{line(rng, 20)}" for _ in range(n)]
        assert sum(r.n_dropped for r in dedup_lines(frame(spark, texts)).collect()) == (0 if n < 20 else 19)


@pytest.mark.parametrize("seed", range(4))
def test_small_worlds(spark, seed):
    """Few words, so that leaves, supports and templates collide and tie in every way."""
    rng = random.Random(seed)
    make = lambda: " ".join(rng.choice(["a", "b", "c1", "d", "E"]) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 52])))
    pool = [make() for _ in range(60)]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.7 else make() for _ in range(rng.randrange(6))) or None for _ in range(90)]
    texts += texts[:7]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([*rows, rows[5], rows[9]], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs).collect())
    assert got == expected([*rows, rows[5], rows[9]])


def test_bitmap_only_lets_through(spark):
    """Leaves that share slots change nothing."""
    rng = random.Random(9)
    texts = [f"{line(rng, 20)}\nPosted by {line(rng, 2)} on monday at noon\n{line(rng, 60)}" for _ in range(30)] + ["x\n" + line(rng, 60)] * 3
    want = Counter(map(tuple, dedup_lines(frame(spark, texts)).collect()))
    assert Counter(map(tuple, dedup_lines(frame(spark, texts), slot_bits=13).collect())) == want
