"""Evidence levels, gates and row usability: ordered decision lists as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import first_of

# Markers of study designs in publication types and index terms.
COHORT_TYPES = ("cohort studies", "observational study", "longitudinal studies", "prospective studies", "retrospective studies")
ANIMAL_TERMS = ("mice", "mouse", "disease models, animal", "animals, laboratory", "mice, inbred", "mice, knockout")
ANIMAL_TEXT = (" in mice", " in mouse", " murine ", " mouse model", " mice model", " rat model", "c57bl/6")
CULTURE_TERMS = ("cells, cultured", "cell line", "in vitro")
# What a level takes from a search score.
LEVEL_PENALTY = {"mouse": 0.08, "in_vitro": 0.05}


def any_in(column: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(t)) for t in terms])


def joined(array: Column, by: str = " | ") -> Column:
    return F.lower(F.coalesce(F.array_join(array, by), F.lit("")))


def document_level(title: Column, abstract: Column, types: Column, mesh: Column, source: Column, journal: Column, keywords: Column) -> Column:
    """Evidence level of a paper, first match wins; expression series are read from their taxon and type."""
    t, m = joined(types), joined(mesh)
    title_ = F.lower(F.coalesce(title, F.lit("")))
    text = F.concat(title_, F.lit(" "), F.lower(F.coalesce(abstract, F.lit(""))))
    head = F.substring(text, 1, 2500)
    has = lambda c, s: F.contains(c, F.lit(s))
    trial = has(t, "clinical trial") & (has(head, "randomized") | has(head, "randomised"))
    rct = has(t, "randomized controlled trial") | has(t, "randomised controlled trial") | (has(t, "controlled clinical trial") & has(head, "random")) | trial
    taxon, kind = joined(keywords, " "), joined(types, " ")
    series = first_of({"mouse": has(taxon, "mus musculus") | has(taxon, "mouse"), "in_vitro": has(kind, "in vitro") | has(kind, "cell line"), "other": F.lit(True)})
    paper = first_of({
        "meta_analysis": has(t, "meta-analysis") | has(t, "meta analysis"),
        "systematic_review": has(t, "systematic review"),
        "rct": rct,
        "case_report": has(t, "case report"),
        "case_series": has(t, "case series") | has(title_, "case series"),
        "review": has(t, "review"),
        "cohort": any_in(t, COHORT_TYPES) | has(m, "cohort studies"),
        "in_vitro": any_in(m, CULTURE_TERMS) | has(F.substring(text, 1, 2000), "in vitro"),
        "mouse": ~has(t, "clinical trial") & ~has(t, "randomized controlled trial") & (any_in(m, ANIMAL_TERMS) | any_in(text, ANIMAL_TEXT)),
        "other": F.size(types) > 0,
        "unknown": F.lit(True),
    })
    return F.when((journal == "NCBI GEO") | (source == "geo"), series).otherwise(paper)


def trial_level(study_type: Column) -> Column:
    return F.coalesce(first_of({"cohort": F.upper(study_type) == "OBSERVATIONAL", "clinical_trial": F.upper(study_type) == "INTERVENTIONAL"}), F.lit("unknown"))


def penalty(level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LEVEL_PENALTY.items() for x in p]), level), F.lit(0.0))


def relevant(text: Column, decisive: str, suggestive: str, disqualifying: str) -> Column:
    """Decisive, or suggestive and not disqualified."""
    return text.rlike(decisive) | (text.rlike(suggestive) & ~text.rlike(disqualifying))


def centred(title: Column, body: Column, topic: str) -> Column:
    """The title names the topic, or the body does twice."""
    return F.contains(F.lower(title), F.lit(topic)) | (F.regexp_count(F.lower(body), F.lit(topic)) >= 2)


def public_evidence(evidence: Column, restricted: tuple[str, ...]) -> Column:
    """Evidence entries without those of restricted sources (by prefix)."""
    return F.filter(evidence, lambda e: ~reduce(lambda a, b: a | b, [F.startswith(e, F.lit(p)) for p in restricted]))


def public_ids(ids: Column, restricted: tuple[str, ...]) -> Column:
    return F.map_filter(ids, lambda k, v: ~k.isin(*restricted))


def usable_rows(rows: DataFrame, caps: DataFrame, excluded: tuple[str, ...], least_n: int) -> DataFrame:
    """Result rows that may be shown.

    Complete; no excluded flag; where a trial's instrument has a central read, only that;
    no later than the trial's design week unless from a publication; enough analysed.
    ``caps`` has one row a trial (source_id, cap).
    """
    complete = F.col("week").isNotNull() & F.col("percent").isNotNull() & (F.col("n_analyzed") > 0)
    flagged = F.arrays_overlap("flags", F.array(*[F.lit(x) for x in excluded]))
    central = F.max(F.when(F.col("assessor") == "central", 1).otherwise(0)).over(Window.partitionBy("source_id", "instrument"))
    out = rows.withColumn("_central", central).where(complete & ~flagged & ((F.col("_central") == 0) | (F.col("assessor") == "central"))).join(caps, "source_id", "left")
    within = F.col("cap").isNull() | (F.col("week") <= F.col("cap")) | F.array_contains("flags", "from_publication")
    return out.where(within & (F.col("n_analyzed") >= least_n)).drop("_central", "cap")


def anchor_populations(rows: DataFrame, reference_week: int = 24) -> DataFrame:
    """Rows (source_id, anchor): the population each trial measured its reference week on."""
    stated = rows.where(F.col("population").isNotNull() & (F.col("population") != "subgroup") & F.col("week").isNotNull())
    rank = F.struct(F.abs(F.col("week") - reference_week), F.when(F.col("outcome_type") == "PRIMARY", 0).otherwise(1), "week", "population")
    return stated.groupBy("source_id").agg(F.min_by("population", rank).alias("anchor"))


def comparable(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows whose population does not conflict with their trial's anchor; subgroups never stay."""
    both = rows.join(anchors, "source_id", "left")
    return both.where(~F.coalesce(F.col("population") == "subgroup", F.lit(False)) & (F.col("anchor").isNull() | F.col("population").isNull() | (F.col("population") == F.col("anchor"))))


def reported_with_comparator(rows: DataFrame, primary_week: int = 24, retention: float = 0.8) -> DataFrame:
    """The clinical table: one row a (region, agent, dose) cell, with its trial's own control.

    The largest retained report of each trial, the largest trial of each cell, the other
    trials as a list, and the best control arm of the same trial and endpoint.
    """
    series = ["source_id", "arm_label", "endpoint", "assessor"]
    peaked = rows.withColumn("_peak", F.max("n_analyzed").over(Window.partitionBy(*series))).where(F.col("week") == primary_week)
    order = [F.desc("n_analyzed"), F.desc(F.col("outcome_type") == "PRIMARY"), F.desc(F.col("assessor") == "central"), F.col("ordinal")]
    control = peaked.where("arm_role = 'placebo'").withColumn("_n", F.row_number().over(Window.partitionBy("source_id", "endpoint").orderBy(*order))).where("_n = 1")
    control = control.select("source_id", "endpoint", F.col("percent").alias("control_percent"), F.col("n_analyzed").alias("control_n"))
    cell = ["endpoint", "agent", "dose_value"]
    active = peaked.where((F.col("arm_role") == "active") & (F.col("n_analyzed") >= F.col("_peak") * retention))
    per_trial = active.withColumn("_n", F.row_number().over(Window.partitionBy(*cell, "source_id").orderBy(*order))).where("_n = 1")
    ranked = per_trial.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    others = ranked.groupBy(*cell).agg(F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.struct("source_id", "percent", "n_analyzed")))).alias("others"))
    best = ranked.where("_n = 1").select(*cell, "source_id", "percent", "n_analyzed").join(others, cell).join(control, ["source_id", "endpoint"], "left")
    return best.withColumn("difference", F.col("percent") - F.col("control_percent"))
