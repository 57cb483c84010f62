"""Structured and text search over a document or trial table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.lineage import reliable


def contains_any(columns: list[str], term: str) -> Column:
    """Case-insensitive substring match in any of several columns; the term is taken literally."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower())) for c in columns])


def has_element(array: str, value: str) -> Column:
    """Case-insensitive membership in an array of strings."""
    return F.exists(array, lambda x: F.lower(x) == value.lower())


def filtered(
    df: DataFrame,
    sources: list[str] | None = None,
    status: str | None = None,
    phase: str | None = None,
    country: str | None = None,
    has_results: bool | None = None,
    term: str | None = None,
    text_columns: tuple[str, ...] = ("brief_title", "official_title", "summary"),
) -> DataFrame:
    """The conjunction of the filters that are given, over a trial table."""
    tests = [
        F.col("source").isin(*sources) if sources else None,
        F.lower("status") == status.lower() if status else None,
        has_element("phases", phase) if phase else None,
        has_element("countries", country) if country else None,
        F.col("has_results") == has_results if has_results is not None else None,
        contains_any(list(text_columns), term) if term else None,
    ]
    return reduce(lambda d, t: d.where(t), [t for t in tests if t is not None], df)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def at_word_start(text: Column, token: str) -> Column:
    """Whether a lower-case text has a token at a word start; the pattern runs only where the token's first part occurs at all."""
    return F.contains(text, F.lit(token.split("-")[0])) & text.rlike(tx.token_pattern(token))


def relevance(df: DataFrame, key: str, text: str, tokens: list[str], weight: Column | None = None) -> DataFrame:
    """Rows (key, tokens, relevance): tokens matched at word starts, weighted by smoothed inverse document frequency among the matches.

    Texts are matched once: what each row found is stored, a bit a token, then counted and weighed.
    """
    lowered = df.select(key, F.lower(text).alias("t"), (weight if weight is not None else F.lit(1.0)).alias("w"))
    rows = lowered.select(key, "w", F.array(*[at_word_start(F.col("t"), t) for t in tokens]).alias("found"))
    hits = reliable(rows.where(F.exists("found", lambda x: x)))
    counts = hits.agg(F.struct(F.count("*").alias("n"), F.array(*[F.count_if(F.col("found")[i]) for i in range(len(tokens))]).alias("df")))
    scored = hits.withColumn("s", counts.scalar())
    idf = lambda i: F.log((F.col("s.n") + 1.0) / (F.col("s.df")[i] + 1.0)) + 1
    total = reduce(lambda a, b: a + b, [F.when(F.col("found")[i], idf(i)).otherwise(0.0) for i in range(len(tokens))])
    return scored.select(key, F.size(F.filter("found", lambda x: x)).cast("long").alias("tokens"), (F.col("w") * total).alias("relevance"))


def relevant_trials(trials: DataFrame, intent: str, stopwords: frozenset[str] = frozenset(), limit: int = 15, pool: int = 1000) -> DataFrame:
    """Trials by relevance to an intent: pool of the newest matches, quality filter with fallback, weighted rank.

    Titles, conditions, keywords and intervention names count fully, prose counts half.
    """
    tokens = tx.intent_tokens(intent, stopwords)
    primary = F.lower(F.concat_ws(" \n ", "brief_title", "official_title", "conditions", "keywords", F.expr("transform(interventions, x -> x.name)"), F.expr("flatten(transform(interventions, x -> x.other_names))")))
    prose = F.lower(F.concat_ws(" \n ", "summary", F.expr("transform(interventions, x -> x.description)")))
    rows = trials.withColumns({"_primary": primary, "_prose": prose})
    if not tokens:
        return rows.where(F.contains("_primary", F.lit(intent.lower()))).orderBy(F.desc("last_update_date"), F.desc("id")).limit(limit).drop("_primary", "_prose")
    match = {t: F.when(F.col("_primary").rlike(tx.token_pattern(t)), 1.0).when(F.col("_prose").rlike(tx.token_pattern(t)), 0.5).otherwise(0.0) for t in tokens}
    rows = rows.withColumn("_hits", F.array(*[F.struct(F.lit(t).alias("token"), m.alias("w")) for t, m in match.items()]))
    rows = rows.where(F.exists("_hits", lambda h: h["w"] > 0)).orderBy(F.desc("last_update_date"), F.desc("id")).limit(pool)
    stats = rows.select(F.explode("_hits").alias("h")).where("h.w > 0").groupBy("h.token").agg(F.count("*").alias("df"))
    idf = stats.withColumn("n", rows.agg(F.count("*")).scalar()).select(F.struct("token", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf")).alias("e"))
    table = idf.agg(F.map_from_entries(F.collect_list("e"))).scalar()  # one entry a token of the intent
    high = F.exists("phases", lambda p: p.isin("PHASE2", "PHASE3", "PHASE4", "PHASE2/PHASE3")) | F.col("has_results")
    some = rows.agg(F.coalesce(F.bool_or(high), F.lit(False))).scalar()
    rows = rows.withColumn("_some", some).where(high | ~F.col("_some")).withColumn("_idf", table)
    score = F.aggregate("_hits", F.lit(0.0), lambda a, h: a + h["w"] * F.coalesce(F.try_element_at("_idf", h["token"]), F.lit(0.0)))
    bonus = F.col("has_results").cast("int") + F.exists("phases", lambda p: p.isin("PHASE3", "PHASE4")).cast("int")
    return rows.withColumns({"relevance": score, "bonus": bonus}).orderBy(F.desc(F.round("relevance", 9)), F.desc("bonus"), F.desc("id")).limit(limit).drop("_primary", "_prose", "_hits", "_idf", "_some")
