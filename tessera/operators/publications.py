"""Judging papers, trials and sample series: ordered decision lists over columns.

A list's rules are data: each has a name, what it looks at, and the verdict it settles.  The
first rule that holds decides, and its name comes with the verdict, so that a reader can
see why.  Vocabularies are parameters; ``Words`` has a general set for clinical papers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Words:
    """What decides whether a paper reports a trial: publication types, and words of titles and abstracts."""

    never: tuple[str, ...] = ("Review", "Meta-Analysis", "Letter", "Editorial", "Comment", "Case Reports")
    trial: tuple[str, ...] = ("Clinical Trial", "Randomized Controlled Trial", "Controlled Clinical Trial")
    about: tuple[str, ...] = ("trials", "systematic review", "meta-analysis", "pooled analysis", "post hoc", "case report")
    not_people: tuple[str, ...] = ("in vitro", "mice", "mouse", "rats", "cell line")
    design: tuple[str, ...] = ("randomised", "randomized", "double-blind", "placebo-controlled", "open-label", "clinical trial")
    no_treatment: tuple[str, ...] = ("prevalence", "serum level", "survey", "diagnosis")
    treatment: tuple[str, ...] = ("treatment", "therapy", "cream", "tablet", "efficacy")
    enrolled: tuple[str, ...] = ("patients were enrolled", "patients were included", "participants were", "patients were treated")
    allocated: tuple[str, ...] = ("randomly assigned", "randomised to", "randomized to", "were allocated")
    compares: tuple[str, ...] = ("versus", "compared with", "compared to")
    prospective: tuple[str, ...] = ("prospective", "randomised", "randomized", "double-blind", "placebo")
    retrospective: tuple[str, ...] = ("retrospective", "chart review", "case-control", "cross-sectional")
    extra: dict[str, tuple[str, ...]] = field(default_factory=dict)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in a text, in any case, a hyphen or a space between its parts; an empty list never does."""
    if not words:
        return F.lit(False)
    pattern = "|".join(w.replace("-", " ").replace(" ", r"[\s-]+") for w in words)
    return F.coalesce(text.rlike(rf"(?i)(?<![a-z0-9])(?:{pattern})(?![a-z0-9])"), F.lit(False))


def decide(rules: list[tuple[str, Column, Column | bool]], otherwise: bool = False) -> Column:
    """(verdict, rule) by the first rule that holds."""
    out = None
    for name, holds, verdict in rules:
        told = F.struct((verdict if isinstance(verdict, Column) else F.lit(verdict)).alias("verdict"), F.lit(name).alias("rule"))
        out = F.when(holds, told) if out is None else out.when(holds, told)
    return out.otherwise(F.struct(F.lit(otherwise).alias("verdict"), F.lit("none").alias("rule")))


def reports_a_trial(title: Column, abstract: Column, types: Column, words: Words = Words()) -> Column:
    """Whether a paper reports a trial, not discusses trials: (verdict, rule).

    A publication type can rule a paper out.  Then the title counts: papers about trials and
    work not done in people are out, a named design is in, measurements without a treatment
    are out.  Then the type can rule it in.  Else the title must name a treatment, and the
    abstract must count people or say how they were assigned; without an abstract the title
    must compare.
    """
    of = lambda kinds: F.arrays_overlap(F.coalesce(types, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in kinds]))
    blank = F.trim(F.coalesce(abstract, F.lit(""))) == ""
    told = has_any(abstract, words.enrolled) | has_any(abstract, words.allocated)
    return decide(
        [
            ("type rules it out", of(words.never), False),
            ("about trials", has_any(title, words.about), False),
            ("not in people", has_any(title, words.not_people), False),
            ("title names a design", has_any(title, words.design), True),
            ("no treatment studied", has_any(title, words.no_treatment), False),
            ("type rules it in", of(words.trial), True),
            ("title names no treatment", ~has_any(title, words.treatment), False),
            ("abstract", ~blank, told),
            ("title compares", has_any(title, words.compares), True),
        ]
    )


def studies_topic(title: Column, abstract: Column, topic: tuple[str, ...], other: tuple[str, ...]) -> Column:
    """Whether a paper's subjects have the topic: (verdict, rule).

    A title that names another condition settles it against, unless it names people with the
    topic; one that names the topic settles it for; else the abstract must say that people
    with the topic were studied.
    """
    people = tuple(p.format(t) for t in topic for p in ("patients with {}", "in {}", "{} patients", "treatment of {}"))
    return decide(
        [
            ("title names another condition", has_any(title, other) & ~has_any(title, people), False),
            ("title names the topic", has_any(title, topic), True),
            ("abstract names them as subjects", has_any(abstract, people), True),
        ]
    )


def topic_as_outcome(title: Column, abstract: Column, types: Column, topic: tuple[str, ...], condition: tuple[str, ...], agents: tuple[str, ...], words: Words = Words()) -> Column:
    """Whether a trial in another condition reports the topic as what followed an agent."""
    text = F.concat_ws(" ", title, abstract)
    trial = reports_a_trial(title, abstract, types, words)["verdict"]
    return has_any(text, topic) & ~studies_topic(title, abstract, topic, condition)["verdict"] & trial & has_any(text, condition) & has_any(text, agents)


def design_of(title: Column, abstract: Column, words: Words = Words()) -> Column:
    """``retrospective`` where a paper says so and says nothing of an assignment."""
    text = F.concat_ws(" ", title, abstract)
    return F.when(has_any(text, words.retrospective) & ~has_any(text, words.prospective), "retrospective").otherwise("prospective_or_unstated")


def class_relation(conditions: Column, close: tuple[str, ...], safety: tuple[str, ...]) -> Column:
    """How near a trial of the same drug class is: by what its conditions (an array) name."""
    named = F.array_join(conditions, " | ")
    return F.when(has_any(named, close), "close").when(has_any(named, safety), "class_safety").otherwise("distant")


def relevant_series(samples: DataFrame, term: str, phenotype_keys: tuple[str, ...]) -> DataFrame:
    """Rows (series, relevant, samples): whether a series is about a term.

    samples has (series, series_title, title, source_name, characteristics).  The series'
    title counts, a sample's title and source, and characteristics that name a phenotype;
    prose about other things does not.
    """
    says = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
    kept = F.map_filter("characteristics", lambda k, v: k.isin(*phenotype_keys) & F.contains(F.lower(v), F.lit(term.lower())))
    hit = says(F.col("series_title")) | says(F.col("title")) | says(F.col("source_name")) | (F.coalesce(F.size(kept), F.lit(0)) > 0)
    return samples.groupBy("series").agg(F.bool_or(hit).alias("relevant"), F.count("*").alias("samples"))


def trusted_claims(claims: DataFrame, never: tuple[str, ...], only_with: dict[str, str]) -> DataFrame:
    """Claims (subject, predicate, object) of trusted kinds: some predicates never are, some only with a certain object."""
    kept = claims.where(~F.col("predicate").isin(*never)) if never else claims
    for predicate, thing in only_with.items():
        kept = kept.where((F.col("predicate") != predicate) | (F.col("object") == thing))
    return kept
