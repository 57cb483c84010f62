"""Ingestion steps: nested results to rows, keep filters, skips of what is held, scope stamps, migrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten_results(trials: DataFrame) -> DataFrame:
    """Measures, classes, categories and measurements as rows; group titles looked up, class denominators fall back to the measure's.

    Values stay text; only a participants denominator counts.
    """
    people = lambda d: F.try_element_at(F.map_from_entries(F.flatten(F.transform(F.filter(d, lambda x: F.lower(x["units"]) == "participants"), lambda x: F.transform(x["counts"], lambda c: F.struct(c["groupId"], c["value"]))))), F.col("group_id"))
    titles = F.map_from_entries(F.transform("m.groups", lambda g: F.struct(g["id"], g["title"])))
    rows = trials.select("source_id", F.posexplode_outer("measures").alias("measure_no", "m"))
    rows = rows.select("source_id", "measure_no", F.col("m.title").alias("title"), F.col("m.paramType").alias("param_type"), F.col("m.unitOfMeasure").alias("unit"), titles.alias("titles"), F.col("m.denoms").alias("denoms"), F.posexplode_outer("m.classes").alias("class_no", "c"))
    rows = rows.select("*", F.col("c.title").alias("class_title"), F.col("c.denoms").alias("class_denoms"), F.explode_outer("c.categories").alias("k")).drop("c")
    rows = rows.select("*", F.explode("k.measurements").alias("x")).select("*", F.col("x.groupId").alias("group_id"), F.col("x.value").alias("value"))
    n = F.coalesce(people(F.col("class_denoms")), people(F.col("denoms")))
    return rows.select("source_id", "measure_no", "class_no", "title", "class_title", "param_type", "unit", "group_id", F.try_element_at("titles", F.col("group_id")).alias("group_title"), "value", n.try_cast("int").alias("n_analyzed"))


def adverse_event_groups(trials: DataFrame) -> DataFrame:
    g = trials.select("source_id", F.explode("event_groups").alias("g"))
    return g.select("source_id", F.col("g.id").alias("group_id"), F.col("g.title").alias("title"), *[F.col(f"g.{k}").try_cast("int").alias(k) for k in ("seriousNumAffected", "seriousNumAtRisk", "otherNumAffected")])


def with_overrides(rows: DataFrame, table: DataFrame, key: str, columns: list[str], only: Column) -> DataFrame:
    """Columns replaced by a small table's values where it has the key and the row qualifies."""
    small = table.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = rows.join(small, key, "left")
    use = F.coalesce(F.col("_hit"), F.lit(False)) & only
    return both.withColumns({c: F.when(use, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_hit", *[f"_{c}" for c in columns])


def by_class(found: DataFrame, current: DataFrame, key: str, order: str, scope: str) -> DataFrame:
    """Records found under several names, once each (the first name wins); the scope is stamped on new ones only."""
    w = Window.partitionBy(key).orderBy(order)
    first = found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    held = current.select(key, F.col("scope").alias("_old"), F.lit(True).alias("_held"))
    both = first.join(held, key, "left")
    return both.withColumn("scope", F.when(F.col("_held"), F.col("_old")).otherwise(F.lit(scope))).drop("_old", "_held")


def not_held(items: DataFrame, held: dict[str, DataFrame], order: str) -> DataFrame:
    """Items none of whose keys is held, each key accepted once (the first item in order wins).

    held maps a key column to a frame with that column; a null key holds nothing.
    """
    out = items
    for key, known in held.items():
        out = out.join(known.select(key).distinct(), key, "left_anti")
    for key in held:
        nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
        out = out.withColumn("_n", F.when(F.col(key).isNotNull(), nth).otherwise(1)).where("_n = 1").drop("_n")
    return out


def held_out(identifier: Column, parts: int = 20) -> Column:
    """Whether sha256(identifier) as a number is divisible by 20: by its last hex digit (4) and its digit sum (5, as 16 is 1 mod 5)."""
    if parts != 20:
        raise ValueError("the rule by digits is for 20 parts")
    digest = F.sha2(identifier, 256)
    # translate each digit to its value as a two-digit number, then sum the pairs.
    pairs = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(digest, "([0-9])", "0$1"), "([a-f])", "1$1"), F.lit("0[0-9]|1[a-f]"), F.lit(0))
    value = lambda p: F.when(F.startswith(p, F.lit("0")), F.substring(p, 2, 1).cast("int")).otherwise(F.ascii(F.substring(p, 2, 1)) - 87)
    sums = F.aggregate(pairs, F.lit(0), lambda a, p: a + value(p))
    last = value(F.element_at(pairs, -1))
    return (last % 4 == 0) & (sums % 5 == 0)


def migrated(df: DataFrame, defaults: dict[str, Column], repairs: dict[str, Column]) -> DataFrame:
    """Missing columns with their defaults, and values repaired."""
    missing = {k: v for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing | repairs) if missing or repairs else df


def category_features(rows: DataFrame, key: str, category: str, most: int = 128) -> DataFrame:
    """Rows (key, features): unit-length multi-hot vectors over the most common categories."""
    top = [r[0] for r in rows.groupBy(category).agg(F.count("*").alias("n")).orderBy(F.desc("n"), category).limit(most).select(category).collect()]  # most rows
    sets = rows.groupBy(key).agg(F.collect_set(category).alias("_c"))
    hot = F.array(*[F.array_contains("_c", t).cast("double") for t in top])
    n = F.sqrt(F.aggregate(hot, F.lit(0.0), lambda a, x: a + x))
    return sets.select(key, F.transform(hot, lambda x: x / F.when(n == 0, 1.0).otherwise(n)).alias("features"))


def risk_scores(associations: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Genes with their largest -log10(p) * (1 + abs(log2 OR)), rescaled to 0..5, merged with other gene maps (gene, value); missing values are 0."""
    genes = associations.where("p_value > 0").select(F.explode(F.split("genes", r"\s*,\s*")).alias("gene"), (-F.log10("p_value") * (1 + F.abs(F.log2("odds_ratio")))).alias("s"))
    raw = genes.groupBy("gene").agg(F.max("s").alias("s"))
    scaled = raw.withColumn("_top", raw.agg(F.max("s")).scalar()).select("gene", (5 * F.col("s") / F.col("_top")).alias("risk"))
    named = [o.select("gene", F.col("value").alias(f"value_{i}")) for i, o in enumerate(others)]
    out = reduce(lambda a, b: a.join(b, "gene", "full"), named, scaled)
    return out.na.fill(0.0)


def kind_table(nodes: DataFrame, kind: str) -> DataFrame:
    """Offset and count of each kind among nodes sorted by kind: for sampling within a kind."""
    counts = nodes.groupBy(kind).agg(F.count("*").alias("n"))
    return counts.withColumn("offset", F.sum("n").over(Window.orderBy(kind)) - F.col("n"))


def lineage_profile(counts: DataFrame, markers: DataFrame, floor: int = 500, least: float = 0.5) -> DataFrame:
    """Single cells (cell, gene, n) to lineages by their best marker mean of log1p counts per 10,000; then means and detection rates by gene and lineage."""
    sized = counts.withColumn("size", F.sum("n").over(Window.partitionBy("cell"))).where(F.col("size") >= floor)
    logged = sized.withColumn("x", F.log1p(F.col("n") * 1e4 / F.col("size")))
    of = markers.groupBy("lineage").agg(F.count("*").alias("markers"))
    score = logged.join(markers, "gene").groupBy("cell", "lineage").agg(F.sum("x").alias("s")).join(of, "lineage").withColumn("s", F.col("s") / F.col("markers"))
    best = score.groupBy("cell").agg(F.max("s").alias("s"), F.max_by("lineage", F.struct("s", "lineage")).alias("lineage")).where(F.col("s") >= least)
    cells = best.groupBy("lineage").agg(F.count("*").alias("cells"))
    per = logged.join(best.select("cell", "lineage"), "cell").groupBy("gene", "lineage").agg(F.sum("x").alias("x"), F.count_if(F.col("n") > 0).alias("d")).join(cells, "lineage")
    return per.select("gene", "lineage", (F.col("x") / F.col("cells")).alias("mean"), (F.col("d") / F.col("cells")).alias("detected"))


def atlas_record(trials: DataFrame, catalogue: dict[str, tuple[str, ...]]) -> DataFrame:
    """Registry trials as atlas rows: agents, routes, number of arms, and whether light was part of the treatment.

    Routes come from interventions that are no placebo.  ``phototherapy`` has three values: a
    trial that lists its interventions has it or has it not; for one that lists none it is null.
    """
    from tessera.functions.labels import CONTROL_WORDS, LIGHT_WORDS, ROUTE_WORDS, any_word
    from tessera.functions.text import match_aliases

    none = F.array().cast("array<string>")
    names = F.transform(F.coalesce("interventions", F.array().cast(trials.schema["interventions"].dataType)), lambda i: F.lower(F.concat_ws(" ", i["name"], i["description"])))
    rows = trials.withColumn("_i", names).withColumn("_own", F.filter("_i", lambda x: ~x.rlike(any_word(CONTROL_WORDS))))
    said = F.array_join("_i", " | ")
    routes = F.array_compact(F.array(*[F.when(F.exists("_own", lambda x: x.rlike(any_word(words))), F.lit(route)) for route, words in ROUTE_WORDS.items()]))  # noqa: B023
    light = F.when(F.size("_i") > 0, said.rlike(any_word(LIGHT_WORDS)))
    agents = F.coalesce(match_aliases(said, catalogue), none)
    return rows.select("source_id", agents.alias("agents"), F.array_sort(routes).alias("routes"), F.size("_i").alias("interventions"), light.alias("phototherapy"))


def watch(feeds: dict[str, DataFrame], since: str, catalogue: dict[str, tuple[str, ...]], most: int) -> DataFrame:
    """Hits of several feeds (id, title, date) on or after a day, in one form with the agents that titles name, the newest first."""
    from tessera.functions.text import match_aliases

    parts = [df.where(F.col("date") >= F.lit(since).cast("date")).select(F.lit(name).alias("feed"), F.col("id").cast("string").alias("id"), "title", "date") for name, df in feeds.items()]
    hits = reduce(lambda a, b: a.unionByName(b), parts)
    return hits.withColumn("agents", match_aliases(F.col("title"), catalogue)).orderBy(F.desc("date"), "feed", "id").limit(most)
