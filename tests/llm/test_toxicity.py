"""The classifier by brute force and on rows it did not learn from."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from small_tables import prose

from tessera.llm import toxicity


def slow_grams(text):
    """Character n-grams within words, a word's ends as a space."""
    words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in "".join(c.lower() if c.isascii() else c for c in text)).split()
    out = set()
    for w in words:
        b = b" " + w.encode() + b" "
        out |= {b[i : i + n] for n in toxicity.ORDERS for i in range(len(b) - n + 1)}
    return out


def test_grams_by_brute_force():
    rng = random.Random(1)
    texts = ["", "a", "ab", "Abc DEF-abc", "é über", "x1y2", " lead", "trail ", *[prose(rng, lang, rng.randrange(1, 60)) for lang in ("en", "de", "fr") for _ in range(20)]]
    who, features = toxicity.grams(pa.array(texts))
    known = {}
    for i, t in enumerate(texts):
        mine = set(features[who == i].tolist())
        assert len(mine) == len(slow_grams(t)), t  # 2**20 slots: none of these few meet
        assert set(toxicity.grams(pa.array([t]))[1].tolist()) == mine
        known[i] = mine
    assert known[3] & known[2] and not known[0]


def test_scores_are_sums_over_a_texts_features(spark):
    rng = random.Random(2)
    texts = [prose(rng, "en", 30) + (" idiot moron" if i % 3 == 0 else "") for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, y int")
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(7), labels)
    assert np.array_equal(model.wanted, again.wanted) and np.allclose(model.weights, again.weights) and abs(model.intercept - again.intercept) < 1e-9
    probe = [*texts[:50], "", "idiot", "IDIOT!", "some idiots"]
    for t, s in zip(probe, model.score(pa.array(probe))):
        z = model.intercept + sum(model.weights[list(set(toxicity.grams(pa.array([t]))[1].tolist()))])
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-12
    # The ratios are those of naive Bayes: features of the marked words weigh for the label.
    marked = toxicity.grams(pa.array(["idiot"]))[1]
    assert (model.weights[marked] > 0).all() and model.wanted[marked].all()


def test_rows_not_learned_from(spark, tmp_path):
    from small_tables import save

    rng = random.Random(3)
    bad = ["idiot", "moron", "scum", "trash", "clown"]

    def text(toxic):
        w = prose(rng, "en", rng.randrange(10, 200)).split()
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    truth = {i: rng.random() < 0.3 for i in range(1500)}
    docs = [{"doc_id": i, "text": text(t), "lang": "en", "source": "s", "n_chars": 1} for i, t in truth.items()]
    folder = save(tmp_path, {"documents": docs, "labels": [{"doc_id": i, "quality": 1, "toxic": int(t)} for i, t in truth.items()], "pages": [], "benchmark": []})
    got = [r for r in toxicity.op1_toxicity(spark, folder).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) > 200 and all(r.held_out for r in got)
    right = sum(r.predicted == truth[r.doc_id] for r in got)
    assert right >= 0.97 * len(got)
