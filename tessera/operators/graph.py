"""A property graph with provenance: merges, replacement, neighbourhoods, components, scores.

Entities are (kind, key, name, aliases, external_ids); edges are (subject, predicate,
object, confidence, claim, causal_level, extraction_method, evidence).  Merge rules that
depend on order read an explicit ``ordinal``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.operators.joins import incident
from tessera.operators.lineage import reliable, release
from tessera.operators.ordering import ranked

# Rungs of the causal ladder, weakest first.
LADDER = ("association", "correlation_in_human", "perturbation_in_vitro", "perturbation_in_animal", "perturbation_in_human")
MOST_ALIASES = 30


def causal_rank(level: Column) -> Column:
    """Place on the ladder; -1 for what is not on it."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LADDER]), level), F.lit(0)).cast("int") - 1


def _ordered(value: Column, ordinal: str) -> Column:
    """Values of a group in order of the ordinal."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), value.alias("v")))), lambda x: x["v"])


def merge_entities(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row a (kind, key): the longest name (the latest of equals), first-seen aliases, last identifiers.

    Names and aliases are made distinct before they are ordered, so a hot entity's group is
    as large as its distinct names.
    """
    seen = rows.select("kind", "key", ordinal, F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    first = seen.groupBy("kind", "key", "alias").agg(F.min(ordinal).alias("o"))
    aliases = first.groupBy("kind", "key").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o", "alias"))), lambda x: x["alias"]), 1, MOST_ALIASES).alias("aliases"))
    ids = rows.select("kind", "key", ordinal, F.explode("external_ids").alias("k", "v"))
    last = ids.groupBy("kind", "key", "k").agg(F.max_by("v", ordinal).alias("v"))
    external = last.groupBy("kind", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("external_ids"))
    names = rows.groupBy("kind", "key").agg(F.max_by("name", F.struct(F.length("name"), F.col(ordinal))).alias("name"))
    return names.join(aliases, ["kind", "key"]).join(external, ["kind", "key"], "left")


def merge_edges(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row a triple: largest confidence, observed over asserted, strongest observed rung, first method, distinct evidence in order."""
    triple = ["subject", "predicate", "object"]
    observed = F.col("claim") == "observed"
    first = rows.groupBy(*triple, "evidence").agg(
        F.min(ordinal).alias("o"), F.max("confidence").alias("c"), F.bool_or(observed).alias("seen"),
        F.max(F.when(observed, F.struct(causal_rank(F.col("causal_level")).alias("r"), F.col("causal_level").alias("l")))).alias("level"),
        F.min(F.struct(F.col(ordinal).alias("o"), F.col("extraction_method").alias("m"))).alias("m"),
    )
    return first.groupBy(*triple).agg(
        F.max("c").alias("confidence"), F.when(F.bool_or("seen"), "observed").otherwise("asserted").alias("claim"), F.max("level")["l"].alias("causal_level"),
        F.min("m")["m"].alias("extraction_method"), F.transform(F.array_sort(F.collect_list(F.struct("o", "evidence"))), lambda x: x["evidence"]).alias("evidence"),
    )


def replace_evidence(edges: DataFrame, source: str, wanted: DataFrame) -> DataFrame:
    """Edge evidence (subject, predicate, object, source_type, ref) with one source's rows replaced by wanted.

    An edge left without evidence is gone, as it has no row any more.
    """
    columns = ["subject", "predicate", "object", "source_type", "ref"]
    return edges.where(F.col("source_type") != source).select(*columns).unionByName(wanted.withColumn("source_type", F.lit(source)).select(*columns))


def orphans(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes of removed edges that no edge holds any more."""
    ends = lambda e: e.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    return ends(before).join(ends(after), "node", "left_anti")


def neighbours(edges: DataFrame, start: DataFrame, hops: int, limit: int) -> DataFrame:
    """Edges within one or two hops of the start nodes (node), by confidence; each hop takes at most 2 * limit edges."""
    frontier, seen = start, None
    for _ in range(max(1, min(hops, 2))):
        batch = incident(edges, frontier).orderBy(F.desc("confidence"), "edge_id").limit(2 * limit)
        seen = batch if seen is None else seen.unionByName(batch).dropDuplicates(["edge_id"])
        nodes = batch.select(F.explode(F.array("subject_id", "object_id")).alias("node")).distinct()
        frontier = nodes.join(start, "node", "left_anti")
    return seen.orderBy(F.desc("confidence"), "edge_id").limit(limit)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) over edges (a, b): label is the smallest node that is reachable.

    Labels spread along edges and along themselves, so a path halves in every round.  The
    rows that change are counted while a round is written; a round's table goes when the
    next one is there.
    """
    both = reliable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = reliable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    changed = 1
    while changed:
        known = labels.select(F.col("node").alias("b"), "label")
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        better = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("b"))
        # The label's own label of the last round: a path halves without computing this round twice.
        now = better.join(known, "b").select("node", "old", F.least("b", "label").alias("label"))
        seen = Observation()
        last, labels = labels, reliable(now.observe(seen, F.count_if(F.col("label") != F.col("old")).alias("n")).select("node", "label"))
        changed = seen.get["n"]
        release(last)
    release(both)
    return labels


def linked_records(records: DataFrame, links: DataFrame, priority: Column) -> DataFrame:
    """Registry records (id, source) with the representative of their linked group.

    Links (a, b) within one source are ignored; the representative is the smallest by
    source priority, then id.
    """
    of = records.select("id", "source")
    cross = links.join(of.select(F.col("id").alias("a"), F.col("source").alias("sa")), "a").join(of.select(F.col("id").alias("b"), F.col("source").alias("sb")), "b").where("sa <> sb").select("a", "b")
    grouped = of.join(components(cross).select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    lead = grouped.groupBy("label").agg(F.min_by("id", F.struct(priority, "id")).alias("representative"))
    return grouped.join(lead, "label").select("id", "source", "representative")


def seed_structured(priors: DataFrame, trials: DataFrame, disease: str) -> DataFrame:
    """Edges that structured records state: treatments, mechanisms, associations and trials, with their fixed confidences."""
    edge = lambda s, p, o, c, ref: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), c.cast("double").alias("confidence"), ref.alias("evidence"))
    ref = F.concat_ws(":", "source", "source_id")
    drug = priors.where("kind = 'drug'")
    advanced = F.col("clinical_stage").isin("APPROVAL", "PHASE_4", "PHASE_3")
    treats = drug.select(edge(F.col("name"), "treats", F.lit(disease), F.when(advanced, 0.88).otherwise(0.82), ref).alias("e"))
    acts = drug.select(F.col("name"), ref.alias("ref"), F.explode("mechanisms").alias("m")).select("name", "ref", "m.action_type", F.explode("m.targets").alias("t"))
    action = F.upper("action_type")
    predicate = F.when(action.contains("INHIB") | action.isin("ANTAGONIST", "BLOCKER"), "inhibits").when(action.contains("AGON") | action.isin("ACTIVATOR", "STIMULATOR"), "activates").otherwise("targets")
    mechanism = acts.select(F.struct(F.col("name").alias("subject"), predicate.alias("predicate"), F.col("t.symbol").alias("object"), F.lit(0.84).alias("confidence"), F.col("ref").alias("evidence")).alias("e"))
    target = priors.where("kind = 'target'").select(edge(F.col("name"), "associated_with", F.lit(disease), F.least(F.lit(0.95), 0.45 + F.coalesce("score", F.lit(0.0))), ref).alias("e"))
    tested = trials.select(ref.alias("ref"), "has_results", F.explode("interventions").alias("i")).where("lower(i.type) IN ('drug', 'biological')")
    trial = tested.select(edge(F.col("i.name"), "tested_in", F.col("ref"), F.when(F.col("has_results"), 0.8).otherwise(0.78), F.col("ref")).alias("e"))
    return treats.union(mechanism).union(target).union(trial).select("e.*").withColumns({"claim": F.lit("asserted"), "extraction_method": F.lit("structured"), "causal_level": F.lit(None).cast("string")})


def genetics_edges(associations: DataFrame, disease: str, threshold: float = 5e-8) -> DataFrame:
    """Strongest association of each mapped gene under the threshold, as observed edges."""
    from tessera.functions.text import gene_list

    genes = associations.select("source_id", "p_value", F.explode(gene_list(F.col("mapped_gene"))).alias("gene")).where(F.col("p_value") < threshold)
    best = genes.groupBy("gene").agg(F.min_by("source_id", F.struct("p_value", "source_id")).alias("evidence"), F.min("p_value").alias("p_value"))
    return best.select(F.col("gene").alias("subject"), F.lit("associated_with").alias("predicate"), F.lit(disease).alias("object"), F.lit(0.9).alias("confidence"), "evidence", F.lit("observed").alias("claim"), F.lit("human_genetics").alias("causal_level"), F.lit("genetics").alias("extraction_method"))


def expression_edges(results: DataFrame, disease: str) -> DataFrame:
    """Genes that change in expression: 0.85 where two series or more agree on the sign, else 0.65."""
    agree = results.groupBy("gene", F.signum("change").alias("sign")).agg(F.countDistinct("series").alias("n"), F.array_sort(F.collect_set("series")).alias("evidence"))
    best = agree.groupBy("gene").agg(F.max(F.struct("n", "sign", "evidence")).alias("b"))
    return best.select(F.col("gene").alias("subject"), F.lit("changes").alias("predicate"), F.lit(disease).alias("object"), F.when(F.col("b.n") >= 2, 0.85).otherwise(0.65).alias("confidence"), F.col("b.evidence").alias("evidence"))


def undirected(pairs: DataFrame, a: str, b: str, weight: str, most: int) -> DataFrame:
    """Each unordered pair once with its largest weight, the heaviest first."""
    once = pairs.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(weight).alias("weight")).where("a <> b")
    return once.orderBy(F.desc("weight"), "a", "b").limit(most)


def triple_ids(edges: DataFrame) -> DataFrame:
    """Edges with dense node and predicate numbers, in order of names."""
    nodes = edges.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    ids = ranked(nodes, [F.col("name")]).select("name", (F.col("rank") - 1).alias("id"))
    preds = edges.select("predicate").distinct().select("predicate", (F.row_number().over(Window.orderBy("predicate")) - 1).alias("p"))  # a fixed set of kinds
    return edges.join(ids.select(F.col("name").alias("subject"), F.col("id").alias("s")), "subject").join(ids.select(F.col("name").alias("object"), F.col("id").alias("o")), "object").join(preds, "predicate")


def split_by_hash(df: DataFrame, key: Column, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Column ``split``: a stable random split by the key's hash."""
    u = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test"))


def complex_score(head_re: Column, head_im: Column, rel_re: Column, rel_im: Column, tail_re: Column, tail_im: Column) -> Column:
    """ComplEx: the real part of the trilinear product with the tail's conjugate."""
    from tessera.functions.vector import dot

    times = lambda x, y: F.zip_with(x, y, lambda p, q: p * q)
    real = F.zip_with(times(head_re, rel_re), times(head_im, rel_im), lambda p, q: p - q)
    imaginary = F.zip_with(times(head_re, rel_im), times(head_im, rel_re), lambda p, q: p + q)
    return dot(real, tail_re) + dot(imaginary, tail_im)


def distmult_score(head: Column, rel: Column, tail: Column) -> Column:
    from tessera.functions.vector import dot

    return dot(F.zip_with(head, rel, lambda p, q: p * q), tail)
