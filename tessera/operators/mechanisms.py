"""The gate of mechanism records: every problem of every record, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import LADDER

# What a record must say, and the states it can be in.
CLAIMS = ("title", "biological_state", "mechanistic_claim", "intervention", "experimental_outcome", "clinical_outcome", "uncertainty")
CONTEXT = ("subtype", "tissue", "cell_type", "disease_stage")
TEST = ("question", "data", "if_correct", "if_incorrect", "decides")
STANCES = ("supports", "contradicts", "neutral")
SEALED = ("sealed", "supported", "refuted")
REFERENCE = r"^(pubmed|pmc|geo|trial|gwas):(.+)$"

RECORD = (
    "id string, status string, " + ", ".join(f"{c} string" for c in CLAIMS) + f", context struct<{','.join(f'{c}:string' for c in CONTEXT)}>, test struct<{','.join(f'{c}:string' for c in TEST)},needs_new_data:boolean,new_data:string>, "
    "evidence array<struct<ref:string,stance:string,causal_level:string,shows:string>>, competing array<struct<explanation:string,distinguished_by:string>>, last_reviewed string, seal struct<sha256:string>"
)


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def seal_of() -> Column:
    """The hash of what a seal fixes: claim, context and test."""
    return F.sha2(F.to_json(F.struct(*CLAIMS, "context", "test")), 256)


def problems(records: DataFrame, statuses: tuple[str, ...], references: DataFrame, levels: DataFrame, forbidden: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows (id, problem): structure, falsifiability, seals, citations that do not resolve, and causal levels the source cannot carry.

    references has (ref) of all that the corpus holds, levels (ref, level) of its documents;
    forbidden names the causal levels that documents of a level cannot carry.  Citations meet
    the corpus by an equi-join.
    """
    some = lambda array, test: F.exists(F.coalesce(F.col(array), F.array().cast(records.schema[array].dataType)), test)
    rules = {
        "id must be kebab-case": blank(F.col("id")) | ~F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"),
        "unknown status": ~F.coalesce(F.col("status").isin(*statuses), F.lit(False)),
        **{f"{c} is empty": blank(F.col(c)) for c in CLAIMS},
        **{f"context.{c} is empty": blank(F.col(f"context.{c}")) for c in CONTEXT},
        **{f"test.{c} is empty": blank(F.col(f"test.{c}")) for c in TEST},
        "the test cannot fail": ~blank(F.col("test.if_correct")) & (F.trim("test.if_correct") == F.trim("test.if_incorrect")),
        "test.new_data is empty": F.coalesce("test.needs_new_data", F.lit(False)) & blank(F.col("test.new_data")),
        "unknown stance": some("evidence", lambda e: ~F.coalesce(e["stance"].isin(*STANCES), F.lit(False))),
        "unknown causal level": some("evidence", lambda e: ~F.coalesce(e["causal_level"].isin(*LADDER), F.lit(False))),
        "evidence does not say what it shows": some("evidence", lambda e: blank(e["shows"])),
        "no supporting evidence": ~some("evidence", lambda e: e["stance"] == "supports"),
        "no competing explanation": F.coalesce(F.size("competing"), F.lit(0)) < 1,
        "a competing explanation is not distinguished": some("competing", lambda c: blank(c["explanation"]) | blank(c["distinguished_by"])),
        "last_reviewed is no date": F.try_to_date("last_reviewed", "yyyy-MM-dd").isNull(),
        "the status needs a seal": F.col("status").isin(*SEALED) & F.col("seal").isNull(),
        "the seal does not match": F.col("seal").isNotNull() & ~F.col("seal.sha256").eqNullSafe(seal_of()),
    }
    found = records.select("id", F.explode(F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules.items()]))).alias("problem"))
    twice = records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    cited = records.select("id", F.explode("evidence").alias("e")).select("id", "e.ref", "e.causal_level")
    good = F.coalesce(F.col("ref").rlike(REFERENCE), F.lit(False))
    malformed = cited.where(~good).select("id", F.concat(F.lit("malformed citation "), F.coalesce("ref", F.lit(""))).alias("problem"))
    missing = cited.where(good).join(references.select("ref").distinct(), "ref", "left_anti").select("id", F.concat("ref", F.lit(" is not in the corpus")).alias("problem"))
    bars = [(level, rung) for level, rungs in forbidden.items() for rung in rungs]
    barred = F.array(*[F.concat(F.lit(a + "/"), F.lit(b)) for a, b in bars]) if bars else F.array().cast("array<string>")
    weak = cited.join(levels, "ref").where(F.array_contains(barred, F.concat_ws("/", "level", "causal_level")))
    carried = weak.select("id", F.concat_ws(" ", "ref", F.lit("is"), "level", F.lit("and cannot carry"), "causal_level").alias("problem"))
    return found.union(twice).union(malformed).union(missing).union(carried)
