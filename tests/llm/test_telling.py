"""Telling terms in full: rare ones, both ways of meeting them, every occurrence, single values."""

from __future__ import annotations

from tessera.llm import pii


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


FILLER = ["the answer of the day is for the reader " * 20] * 40


def test_rare_terms(spark):
    texts = [f"reach zebra at a{i}@x.org" for i in range(6)] + [" ".join(f"hello w@v{i}x{j}.org" for j in range(100)) for i in range(80)]
    docs = frame(spark, texts + FILLER * 20)
    told = {r.term for r in pii.telling_terms(docs).where("kind = 'email'").collect()}
    assert "zebra" in told and "answer" not in told


def test_both_ways_agree(spark):
    docs = frame(spark, [f"reach hotline desk at a{i}@x.org or +1 (555) 100-{1000 + i} for zebra" for i in range(12)] + FILLER + [None, ""])
    ways = [sorted((r.doc_id, str(r.terms), str(r.base)) for r in pii.with_spans(docs, plan_terms=n).collect()) for n in (pii.PLAN_TERMS, 0)]
    assert ways[0] == ways[1] and any("Row" in x[1] for x in ways[0])


def test_every_occurrence(spark):
    texts = [f"reach hotline now at a{i}@x.org" for i in range(40)] + ["the hotline of the day " + "and the rest " * 30 + "Hotline is the answer", "mail hotline@hotline.org"]
    docs = frame(spark, texts + FILLER)
    for n in (pii.PLAN_TERMS, 0):
        got = {r.doc_id: [texts[r.doc_id][x.s : x.e].lower() for x in r.terms] for r in pii.with_spans(docs, plan_terms=n).where("doc_id < 42").collect()}
        assert got[40] == ["hotline", "hotline"] and got[41] == [] and "hotline" in got[0]
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "otline" not in clean[40] and clean[45] == FILLER[0]


def test_single_values(spark):
    others = [" ".join(f"hello w@v{i}x{j}.org" for j in range(100)) for i in range(20)]
    texts = [f"{i} surname sits at one@x.org" for i in map(chr, range(97, 105))] + ["the partly known partly the answer"] * 2
    texts += [f"{i} partly at two@x.org" for i in map(chr, range(97, 105))] + ["once lonely at three@x.org"] * 9
    docs = frame(spark, texts + others + FILLER * 2)
    told = {r.term: r.disclosure for r in pii.telling_terms(docs).collect()}
    assert told["surname"] == 1.0 and "partly" in told and "answer" not in told
    assert "lonely" not in told  # nine copies are one text
