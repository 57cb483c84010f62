"""The query surface over a small store, in the manner of a regression gate."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.operators import embedding
from tessera.service import Engine
from tessera.sources.common import conform


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    docs = [
        ("pubmed", "1", "Topical cream repigments the face", "A randomized trial of the cream", ["Randomized Controlled Trial"]),
        ("pubmed", "2", "Topical cream in mice", "cream cream in mice", ["Journal Article"]),
        ("pubmed", "3", "Light therapy", "phototherapy outcome", ["Review"]),
    ]
    d = spark.createDataFrame(docs, "source string, source_id string, title string, abstract string, publication_types array<string>")
    e.store.upsert("documents", conform(d, "documents"))
    keyed = e.store.read("documents").select(F.xxhash64("source", "source_id").alias("document_id"), "title", "abstract")
    e.store.upsert("embeddings", embedding.embed_documents(keyed, e.store.read("embeddings"), "hash", embedding.hashing_encoder))
    trials = [("ctgov", "N1", "Cream in adults", "COMPLETED", ["PHASE2"], ["France"], True, "2022-01-01"), ("ctgov", "N2", "Tablet", "RECRUITING", ["PHASE1"], ["Spain"], False, "2023-01-01")]
    t = spark.createDataFrame(trials, "source string, source_id string, brief_title string, status string, phases array<string>, countries array<string>, has_results boolean, last_update_date string")
    e.store.upsert("trials", conform(t, "trials"))
    edges = spark.createDataFrame([("cream", "treats", "disease", 0.9), ("gene", "associated_with", "disease", 0.8), ("tablet", "targets", "gene", 0.7)], "subject string, predicate string, object string, confidence double")
    e.store.upsert("graph_edges", conform(edges, "graph_edges"))
    e.store.upsert("graph_entities", conform(spark.createDataFrame([("drug", "cream", "Cream")], "kind string, key string, name string"), "graph_entities"))
    return e


def test_search_puts_trials_before_mice(engine):
    hits = engine.search("topical cream", embedding.hashing_encoder(), 2).collect()
    assert {h.source_id for h in hits} == {"1", "2"} and {h.source_id: h.level for h in hits}["2"] == "mouse"
    assert all(h.adjusted == pytest.approx(h.raw - (0.08 if h.level == "mouse" else 0)) for h in hits)


def test_trials(engine):
    assert [t.source_id for t in engine.trials(phase="phase2", country="FRANCE", status="completed", has_results=True).collect()] == ["N1"]
    assert [t.source_id for t in engine.trials(1, 1).collect()] == ["N1"]
    assert [t.source_id for t in engine.relevant_trials("cream for adults").collect()] == ["N1"]
    with pytest.raises(ValueError):
        engine.trials(1000)


def test_graph(engine):
    one = {(e.subject, e.object) for e in engine.neighbours("Disease", 1).collect()}
    two = {(e.subject, e.object) for e in engine.neighbours("Disease", 2).collect()}
    assert one == {("cream", "disease"), ("gene", "disease")} and two == one | {("tablet", "gene")}
    assert [r.key for r in engine.graph_search("CREAM").collect()] == ["cream"] and engine.export(2).count() == 2


def test_counts(engine):
    assert {(r.name, r.n) for r in engine.stats().collect()} >= {("documents", 3), ("trials", 2), ("graph_edges", 3)}
    assert {(r.dimension, r.value, r.n) for r in engine.trial_stats().collect()} >= {("status", "COMPLETED", 1)}


def test_embedding_is_incremental(engine, spark):
    keyed = engine.store.read("documents").select(F.xxhash64("source", "source_id").alias("document_id"), "title", "abstract")
    assert embedding.embed_documents(keyed, engine.store.read("embeddings"), "hash", embedding.hashing_encoder).count() == 0
    body = spark.createDataFrame([(1, "One passage. " * 30), (2, "Two. " * 60)], "document_id long, body string")
    none = engine.store.read("document_chunks")
    fresh, kept = embedding.embed_full_text(body, none, "hash", embedding.hashing_encoder)
    assert fresh.select("document_id").distinct().count() == 2 and kept.count() == 0
    again, kept = embedding.embed_full_text(body.withColumn("body", F.when(F.col("document_id") == 2, "New text. " * 20).otherwise(F.col("body"))), fresh, "hash", embedding.hashing_encoder)
    assert {r.document_id for r in again.select("document_id").collect()} == {2} and {r.document_id for r in kept.collect()} == {1}


def test_command_line(engine):
    assert "| cream | treats | disease |" in main([engine.store.folder, "export", "--limit", "5"])


def test_candidates_and_predictions(engine, spark):
    priors = [("opentargets", "drug", "C1", "E", "Cream", "PHASE_3"), ("opentargets", "drug", "C2", "E", "Tabletol", "PHASE_2"), ("opentargets", "target", "G", "E", "JAK1", None)]
    engine.store.upsert("priors", conform(spark.createDataFrame(priors, "source string, kind string, source_id string, disease_id string, name string, clinical_stage string"), "priors"))
    edges = spark.createDataFrame([("lotion", "treats", "disease", 0.9, "llm")], "subject string, predicate string, object string, confidence double, extraction_method string")
    engine.store.upsert("graph_edges", conform(edges, "graph_edges"))
    rows = engine.candidates(5).collect()
    assert [r["name"] for r in rows][-1] == "Tabletol" and rows[-1].score == 0 and {r.token for r in rows} == {r.token for r in rows if r.token != "jak1"}
    nodes = spark.createDataFrame([(1, "drug", [1.0, 0.0], "A"), (2, "drug", [0.9, 0.1], "B"), (3, "target", [2.0, 1.0], "C")], "node long, kind string, vector array<double>, name string")
    assert [r.name for r in engine.predictions(nodes, " a ", [1.0, 1.0], 2).collect()] == ["C", "B"]
    assert [r.name for r in engine.predictions(nodes, "A", [1.0, 1.0], 2, "drug").collect()] == ["B"]
    with pytest.raises(KeyError):
        engine.predictions(nodes, "nobody", [1.0, 1.0])
