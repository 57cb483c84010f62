"""The query surface: what a service or a command line asks, as DataFrames over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import drug_token, entity_key, stage_rank, trial_stage
from tessera.functions.vector import dot, literal
from tessera.operators import aggregates, graph, joins, links, scoring, search
from tessera.operators.embedding import Encoder
from tessera.operators.evidence import LEVEL_PENALTY, document_level, penalty, reported_with_comparator
from tessera.operators.ranking import shortlist, top_with_penalty
from tessera.sources.sinks import Store

# The most rows that a request may ask for.
MOST = {"search": 50, "graph_search": 100, "neighbours": 200, "export": 10_000, "candidates": 20, "trials": 100}


def capped(kind: str, limit: int) -> int:
    if not 1 <= limit <= MOST[kind]:
        raise ValueError(f"limit is 1 to {MOST[kind]}")
    return limit


class Engine:
    """Queries over the current versions of the tables of a store."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, Store(spark, folder)

    def stats(self) -> DataFrame:
        """Rows of each table."""
        names = ("documents", "trials", "priors", "graph_entities", "graph_edges", "genetic_associations", "research_projects")
        frames = [self.store.read(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out

    def search(self, query: str, encoder: Encoder, top_k: int = 10) -> DataFrame:
        """Documents by similarity less the penalty of their evidence level."""
        k = capped("search", top_k)
        vectors = self.store.read("embeddings").where("scope = 'title_abstract'")
        scored = vectors.select("document_id", dot(F.col("vector"), literal(encoder([query])[0].tolist())).alias("score"))
        # No penalty is over the largest, so what can win lies within that of the k-th score; documents are read for those only.
        scored = shortlist(scored, "score", k, max(LEVEL_PENALTY.values()))
        docs = self.store.read("documents").withColumn("document_id", F.xxhash64("source", "source_id"))
        both = docs.join(scored, "document_id")
        level = document_level(*[F.col(c) for c in ("title", "abstract", "publication_types", "mesh_terms", "source", "journal", "keywords")])
        ranked = both.withColumns({"level": level, "raw": F.col("score")}).drop("score")
        return top_with_penalty(ranked, "raw", penalty(F.col("level")), "document_id", k).select("source", "source_id", "title", "level", "raw", "adjusted")

    def trials(self, limit: int = 20, offset: int = 0, **filters) -> DataFrame:
        found = search.filtered(self.store.read("trials"), **filters)
        return search.page(found, [F.desc("last_update_date"), F.desc("source_id")], offset, capped("trials", limit))

    def relevant_trials(self, intent: str, limit: int = 15) -> DataFrame:
        rows = self.store.read("trials").withColumn("id", F.xxhash64("source", "source_id"))
        return search.relevant_trials(rows, intent, limit=capped("trials", limit)).drop("id")

    def trial_stats(self) -> DataFrame:
        return aggregates.counts_by_each(self.store.read("trials"), ["source", "status", "has_results"])

    def graph_stats(self) -> DataFrame:
        return aggregates.counts_by_each(self.store.read("graph_edges"), ["predicate", "claim", "causal_level", "extraction_method"])

    def graph_search(self, q: str, limit: int = 25) -> DataFrame:
        hit = (F.col("key") == entity_key(F.lit(q))) | F.contains(F.lower("name"), F.lit(q.lower()))
        return self.store.read("graph_entities").where(hit).orderBy("name", "kind", "key").limit(capped("graph_search", limit))

    def neighbours(self, name: str, hops: int = 1, limit: int = 50) -> DataFrame:
        e = self.store.read("graph_edges").select("*", F.xxhash64("subject", "predicate", "object").alias("edge_id"), F.col("subject").alias("subject_id"), F.col("object").alias("object_id"))
        start = self.spark.range(1).select(entity_key(F.lit(name)).alias("node"))
        return graph.neighbours(e, start, hops, capped("neighbours", limit)).drop("edge_id", "subject_id", "object_id")

    def export(self, limit: int = 1000) -> DataFrame:
        return self.store.read("graph_edges").orderBy(F.desc("confidence"), "subject", "predicate", "object").limit(capped("export", limit))

    def candidates(self, limit: int = 20) -> DataFrame:
        """Drugs by the sum of their components: extracted edges, trials that name them, and documents that mention them."""
        priors = self.store.read("priors").where("kind = 'drug'").select(drug_token(F.col("name")).alias("token"), "name", stage_rank(F.col("clinical_stage")).alias("rank")).where("token IS NOT NULL")
        drugs = priors.groupBy("token").agg(F.max_by("name", F.struct("rank", "name")).alias("name"), F.max("rank").alias("stage"))
        edges = self.store.read("graph_edges").select(drug_token(F.col("subject")).alias("token"), "predicate", "confidence", "extraction_method", F.xxhash64("subject", "predicate", "object").alias("edge_id"))
        trials = self.store.read("trials").withColumns({"text": F.concat_ws(" ", "brief_title", F.expr("transform(interventions, x -> x.name)")), "id": F.concat_ws(":", "source", "source_id")})
        named = joins.words_in_texts(drugs, trials, "token", "id", "text").join(trials.select("id", "has_results", "status", stage_rank(trial_stage(F.col("phases"))).alias("rank")), "id")
        tested = named.groupBy("token").agg(scoring.trial_points(F.coalesce("rank", F.lit(0)), F.coalesce("has_results", F.lit(False)), F.col("status")).alias("trials"))
        papers = self.store.read("documents").select(F.concat_ws(":", "source", "source_id").alias("id"), F.concat_ws(" ", "title", "abstract").alias("text"))
        read = joins.words_in_texts(drugs, papers, "token", "id", "text").groupBy("token").agg(scoring.literature_points(F.count("*")).alias("literature"))
        both = drugs.join(scoring.graph_points(edges, "token"), "token", "left").join(tested, "token", "left").join(read, "token", "left").na.fill(0, ["graph", "trials", "literature"])
        scored = both.withColumn("score", F.col("graph") + F.col("trials") + F.col("literature")).withColumn("strength", scoring.strength(F.col("score")))
        return scored.orderBy(F.desc("score"), F.desc("stage"), "token").limit(capped("candidates", limit))

    def evidence(self, rows: DataFrame) -> DataFrame:
        """The clinical table of result rows: the largest trial of each cell beside its own control."""
        return reported_with_comparator(rows)

    def predictions(self, nodes: DataFrame, head: str, relation: list[float], top_k: int = 15, kind: str | None = None) -> DataFrame:
        """The nodes (node, kind, vector, name) that best complete a head and a relation, without the head itself."""
        start = nodes.where(F.lower("name") == head.strip().lower()).select("node", "vector").first()
        if start is None:
            raise KeyError(head)
        asked = links.distmult_query(literal(start["vector"]), literal(relation))
        return links.top_links(nodes, asked, capped("candidates", top_k), kind, (start["node"],)).join(nodes.select("node", "name"), "node").orderBy("rank")
