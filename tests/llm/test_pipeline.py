"""The pipeline on small tables."""

from __future__ import annotations

import corpus_pipeline


def test_stages(spark, edge_dir, tables, tmp_path):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, edge_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "weights":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert seen["language"].where("text IS NULL OR text = '' OR text = '1234 !!! —'").count() == 0
    kept = {r.doc_id for r in seen["near_copies"].select("doc_id").collect()}
    copies = [d["doc_id"] for d in tables["documents"] if d["text"] and "changed" in d["text"]]
    assert not kept & set(copies[1:])
    passage = tables["benchmark"][0]["text"]
    leaks = [r.doc_id for r in seen["near_copies"].collect() if passage in r.text.lower()]
    assert leaks and not {r.doc_id for r in seen["benchmark"].select("doc_id").collect()} & set(leaks)
    weights = seen["weights"]
    assert weights.count() == seen["benchmark"].count()
    assert weights.where("taken > 2 * size").count() == 0


def test_run_and_empty(spark, edge_dir, empty_dir):
    assert corpus_pipeline.run(spark, edge_dir).count() > 50
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, gone string, keep_0 string")


def test_awkward_rows_stage_by_stage(spark, tmp_path):
    """Repeated rows, null identifiers, one identifier with two texts, ties and clashing columns."""
    from collections import Counter

    from small_tables import prose

    rng = __import__("random").Random(8)
    a, b, c = (prose(rng, "en", 60) for _ in range(3))
    near = a.replace(a.split()[30], "changed", 1)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a, "de", "s", 1), (None, a, "en", "s", 1), (None, near, "en", "s", 1), (2, near, "en", None, 1), (3, b, "en", "s", None), (3, c, "en", "s", 1), (None, prose(rng, "de", 50), "de", "s", 1), (None, None, "de", "s", 1), (4, "", "en", "s", 1)]
    rows += [(100 + i, prose(rng, lang, 40), lang, "t", 1) for lang in ("en", "de") for i in range(20)]
    docs = frame(spark, [(*r, "x", "y", "z") for r in rows])
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, kept, "").write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen[name] = Counter(kept.select("doc_id", "text").collect())
    texts = {r.text for r in seen["language"]}
    assert None not in texts and "" not in texts and seen["language"][(1, a)] == 3
    # The group of a: one row, under its only known smallest identifier; the other texts stay.
    group = Counter({r: n for r, n in seen["near_copies"].items() if r.text in (a, near)})
    assert list(group.items()) == [((1, a), 1)]
    assert seen["near_copies"][(3, b)] == seen["near_copies"][(3, c)] == 1
    unknown = frame(spark, [(None, a, "en", "s", 1, "", "", ""), (None, near, "en", "s", 1, "", "", ""), (None, a, "en", "s", 1, "", "", "")])
    assert corpus_pipeline.near_copies(spark, unknown, "").count() == 1
