"""Queries over ingestion steps, ledger, statistics, passages and streams (inventory X, M, V, 2.14)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import labels, passages, text, udfs
from tessera.operators import discovery, evidence, ingestion, ledger, mechanisms, statistics
from tessera.operators.ordering import ranked
from tessera.operators.statistics import pareto_k
from tessera.plans.registry import load, query
from tessera.streaming import events


@query("x01_flatten_results", """
SELECT o_orderkey::VARCHAR AS source_id, 'Class ' || l_linenumber AS class_title, l_suppkey::VARCHAR AS group_id, 'Arm ' || l_suppkey AS group_title, l_quantity::INTEGER::VARCHAR AS value, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 10 ELSE 99 END::INTEGER AS n_analyzed FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def x01(spark, d):
    l = load(spark, d, "lineitem")
    known = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    arm = F.col("l_suppkey").cast("string")
    denom = lambda n: F.array(F.struct(F.lit("Participants").alias("units"), F.array(F.struct(arm.alias("groupId"), n.cast("string").alias("value"))).alias("counts")))
    own = F.when(F.col("l_linenumber") % 2 == 0, denom(F.col("l_linenumber") * 10))
    cls = F.struct(F.concat(F.lit("Class "), "l_linenumber").alias("title"), own.alias("denoms"), F.array(F.struct(F.array(F.struct(arm.alias("groupId"), F.col("l_quantity").cast("int").cast("string").alias("value"))).alias("measurements"))).alias("categories"))
    m = F.struct(F.lit("Response").alias("title"), F.lit("NUMBER").alias("paramType"), F.lit("percent").alias("unitOfMeasure"), F.array(F.struct(arm.alias("id"), F.concat(F.lit("Arm "), arm).alias("title"))).alias("groups"), denom(F.lit(99)).alias("denoms"), F.array(cls).alias("classes"))
    trials = l.join(known, "l_orderkey").groupBy(F.col("l_orderkey").cast("string").alias("source_id")).agg(F.collect_list(m).alias("measures"))
    return ingestion.flatten_results(trials).select("source_id", "class_title", "group_id", "group_title", "value", "n_analyzed")


@query("x04_overrides", "SELECT s_suppkey, CASE WHEN n_nationkey < 5 AND s_suppkey % 2 = 0 THEN n_name ELSE s_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def x04(spark, d):
    table = load(spark, d, "nation").where("n_nationkey < 5").select("n_nationkey", F.col("n_name").alias("name"))
    rows = load(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("name"))
    return ingestion.with_overrides(rows, table, "n_nationkey", ["name"], F.col("s_suppkey") % 2 == 0).select("s_suppkey", "name")


@query("x05_class_ingestion", "SELECT o_custkey AS id, min(o_orderkey) AS first_order, CASE WHEN o_custkey % 3 = 0 THEN 'old' ELSE 'class' END AS scope FROM orders GROUP BY 1")
def x05(spark, d):
    found = load(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first_order"))
    current = load(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("old").alias("scope"))
    return ingestion.by_class(found, current, "id", "first_order", "class")


@query("x06_title_twins", r"""
WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS tkey FROM documents), held AS (SELECT tkey FROM k WHERE doc_id % 10 = 0), f AS (SELECT * FROM k WHERE doc_id % 10 <> 0 AND tkey NOT IN (SELECT tkey FROM held)) SELECT min(doc_id) AS doc_id FROM f GROUP BY tkey""")
def x06(spark, d):
    k = load(spark, d, "documents").select("doc_id", text.title_key(F.col("text")).alias("tkey"))
    return ingestion.not_held(k.where("doc_id % 10 <> 0"), {"tkey": k.where("doc_id % 10 = 0")}, "doc_id").select("doc_id")


@query("x13_held_out", "SELECT doc_id, list_sum(list_transform(string_split(h, ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 5 = 0 AND (strpos('0123456789abcdef', right(h, 1)) - 1) % 4 = 0 AS held_out FROM (SELECT doc_id, sha256(doc_id::VARCHAR) AS h FROM documents)")
def x13(spark, d):
    return load(spark, d, "documents").select("doc_id", ingestion.held_out(F.col("doc_id").cast("string")).alias("held_out"))


@query("x15_best_bias", """
WITH s AS (SELECT toxic, n_chars / 1000.0::DOUBLE - 2 AS s FROM documents JOIN labels USING (doc_id)), g AS (SELECT i, -4.5::DOUBLE + i * 0.1::DOUBLE AS bias FROM range(0, 91) t(i)), f AS (SELECT i, bias, 2.0 * count(*) FILTER (WHERE s + bias > 0 AND toxic = 1) / (count(*) FILTER (WHERE s + bias > 0) + count(*) FILTER (WHERE toxic = 1)) AS f1 FROM s, g GROUP BY 1, 2) SELECT max(f1) AS f1 FROM f""")
def x15(spark, d):
    s = load(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000.0 - 2).alias("s")).join(load(spark, d, "labels"), "doc_id")
    return statistics.best_bias(s, "toxic", "s", [-4.5 + i * 0.1 for i in range(91)]).select("f1")


@query("x16_candidate_pairs", "SELECT a.l_orderkey, least(a.l_partkey, b.l_partkey) AS x, greatest(a.l_partkey, b.l_partkey) AS y, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_returnflag || b.l_returnflag IN ('RA', 'AR', 'NN') GROUP BY 1, 2, 3")
def x16(spark, d):
    l = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    b = l.select("l_orderkey", *[F.col(c).alias(f"b_{c}") for c in ("l_linenumber", "l_partkey", "l_returnflag")])
    pairs = l.join(b, "l_orderkey").where(F.col("l_linenumber") < F.col("b_l_linenumber")).where(F.concat("l_returnflag", "b_l_returnflag").isin("RA", "AR", "NN"))
    return pairs.groupBy("l_orderkey", F.least("l_partkey", "b_l_partkey").alias("x"), F.greatest("l_partkey", "b_l_partkey").alias("y")).agg(F.count("*").alias("n"))


@query("x17_category_features", """
WITH t AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 8), h AS (SELECT p_brand, count(DISTINCT p_type) FILTER (WHERE p_type IN (SELECT p_type FROM t)) AS hot FROM part GROUP BY 1) SELECT p_brand, hot::BIGINT AS hot, CASE WHEN hot > 0 THEN 1.0 ELSE 0 END::DOUBLE AS norm FROM h""")
def x17(spark, d):
    f = ingestion.category_features(load(spark, d, "part"), "p_brand", "p_type", 8)
    return f.select("p_brand", F.size(F.filter("features", lambda x: x > 0)).cast("long").alias("hot"), F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x).alias("norm"))


@query("x18_risk_scores", """
WITH g AS (SELECT unnest(string_split(p_type, ' ')) AS gene, -log10(p_size * 1e-4) * (1 + abs(log2(1 + p_size / 50.0))) AS s FROM part), r AS (SELECT gene, max(s) AS s FROM g GROUP BY 1), o AS (SELECT p_brand AS gene, count(*)::DOUBLE AS value FROM part GROUP BY 1)
SELECT coalesce(r.gene, o.gene) AS gene, coalesce(5 * s / (SELECT max(s) FROM r), 0) AS risk, coalesce(value, 0) AS value_0 FROM r FULL JOIN o ON r.gene = o.gene""")
def x18(spark, d):
    p = load(spark, d, "part")
    rows = p.select((F.col("p_size") * 1e-4).alias("p_value"), (1 + F.col("p_size") / 50.0).alias("odds_ratio"), F.replace(F.col("p_type"), F.lit(" "), F.lit(",")).alias("genes"))
    return ingestion.risk_scores(rows, [p.groupBy(F.col("p_brand").alias("gene")).agg(F.count("*").cast("double").alias("value"))])


@query("x19_kind_table", "SELECT p_brand, count(*) AS n, (sum(count(*)) OVER (ORDER BY p_brand) - count(*))::BIGINT AS \"offset\" FROM part GROUP BY 1")
def x19(spark, d):
    return ingestion.kind_table(load(spark, d, "part"), "p_brand")


@query("x21_lineage_profile", """
WITH c AS (SELECT l_suppkey AS cell, l_partkey % 30 AS gene, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY cell) AS size FROM c), x AS (SELECT cell, gene, n, ln(1 + n * 1e4 / size) AS x FROM s WHERE size >= 500),
m AS (SELECT g AS gene, 'L' || (g % 3) AS lineage FROM range(0, 9) t(g)), sc AS (SELECT cell, lineage, sum(x) / 3 AS s FROM x JOIN m USING (gene) GROUP BY 1, 2), b AS (SELECT cell, arg_max(lineage, s) AS lineage FROM sc GROUP BY 1 HAVING max(s) >= 0.5), k AS (SELECT lineage, count(*) AS cells FROM b GROUP BY 1)
SELECT gene, lineage, sum(x) / min(cells) AS mean, count(*) FILTER (WHERE n > 0) / min(cells)::DOUBLE AS detected FROM x JOIN b USING (cell) JOIN k USING (lineage) GROUP BY 1, 2""")
def x21(spark, d):
    c = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 30).alias("gene")).agg(F.sum("l_quantity").alias("n"))
    markers = spark.createDataFrame([(g, f"L{g % 3}") for g in range(9)], "gene long, lineage string")
    return ingestion.lineage_profile(c, markers)


@query("x24_ledger_export", "SELECT event_id, event_type, value FROM events")
def x24(spark, d):
    return load(spark, d, "events").select("event_id", "event_type", "value").orderBy("event_id")


@query("x25_ledger_next", """
WITH t AS (SELECT o_custkey AS unit_key, row_number() OVER (ORDER BY o_custkey) AS t FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')), c AS (SELECT o_custkey AS unit_key, min(o_orderkey) AS proposed_at FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT unit_key, proposed_at, (SELECT max(t) FROM t) + row_number() OVER (ORDER BY proposed_at, unit_key) AS t FROM c WHERE unit_key NOT IN (SELECT unit_key FROM t)""")
def x25(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("unit_key"), F.col("o_orderkey").alias("proposed_at"), (F.col("o_orderstatus") == "P").alias("spent"))
    tests = ranked(o.where("spent").select("unit_key").distinct(), [F.col("unit_key")], "t")
    return ledger.new_tests(tests, o.where("NOT spent").select("unit_key", "proposed_at")).select("unit_key", "proposed_at", "t")


@query("x25_ledger_resolve", "SELECT o_orderkey AS sha256, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 4 = 0 THEN 'resolved' ELSE 'pending' END AS status, CASE WHEN o_orderstatus = 'F' THEN 'old' WHEN o_orderkey % 4 = 0 THEN 'new' END AS resolution FROM orders")
def x25b(spark, d):
    o = load(spark, d, "orders")
    f = o.select(F.col("o_orderkey").alias("sha256"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("pending").alias("status"), F.when(F.col("o_orderstatus") == "F", "old").alias("resolution"))
    return ledger.resolved(f, o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("sha256"), F.lit("new").alias("resolution")))


@query("x26_migration", "SELECT doc_id, CASE lang WHEN 'en' THEN 'english' ELSE lang END AS lang, 'asserted' AS claim FROM documents")
def x26(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang")
    return ingestion.migrated(docs, {"claim": F.lit("asserted"), "lang": F.lit("en")}, {"lang": F.when(F.col("lang") == "en", "english").otherwise(F.col("lang"))})


@query("w17_online_alphas", """
WITH RECURSIVE e AS (SELECT event_id AS o, value / 20 AS e, row_number() OVER (ORDER BY event_id) AS t FROM events), r AS (SELECT 0::BIGINT AS t, 0 AS found, NULL::BIGINT AS o, NULL::DOUBLE AS alpha_t, FALSE AS discovery
 UNION ALL SELECT e.t, r.found + CASE WHEN e.e >= -ln(0.1 * 6 / (pi() * pi() * e.t * e.t) * (r.found + 1)) THEN 1 ELSE 0 END, e.o, 0.1 * 6 / (pi() * pi() * e.t * e.t) * (r.found + 1), e.e >= -ln(0.1 * 6 / (pi() * pi() * e.t * e.t) * (r.found + 1)) FROM r JOIN e ON e.t = r.t + 1) SELECT o AS event_id, t::INTEGER AS t, alpha_t, discovery FROM r WHERE t > 0""")
def w17(spark, d):
    e = load(spark, d, "events").select("event_id", (F.col("value") / 20).alias("e"))
    return statistics.online_alphas(e, "event_id", "e", 0.1)


@query("m07_pooled_baseline", """
WITH l AS (SELECT l_returnflag, ln(((r + 0.5) / (n + 1.0)) / (1 - (r + 0.5) / (n + 1.0))) AS x FROM (SELECT l_returnflag, l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS r FROM lineitem GROUP BY 1, 2)) SELECT l_returnflag, count(*) AS trials, 1 / (1 + exp(-avg(x))) AS median FROM l GROUP BY 1""")
def m07(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("responders"))
    return statistics.pooled_baseline(rows, ["l_returnflag"]).select("l_returnflag", "trials", "median")


@query("m06_bounds_check", """
WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS r, max(l_linenumber) AS wk FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, max(n) AS grp FROM g GROUP BY 1) SELECT l_suppkey, l_returnflag, 100.0 * r / grp <= 40 AND 40 <= 100.0 * (r + grp - n) / grp AS inside FROM g JOIN m USING (l_suppkey)""")
def m06(spark, d):
    cells = load(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("threshold")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("responders")).withColumn("week", F.lit(24))
    predictions = cells.select("l_suppkey", "week", "threshold", F.lit(0.4).alias("predicted"))
    return discovery.check_bounds(predictions, cells, ["l_suppkey"]).select("l_suppkey", F.col("threshold").alias("l_returnflag"), "inside")


_LL = "{r} * ln(least(greatest({p}, 1e-12), 1 - 1e-12)) + ({n} - {r}) * ln(1 - least(greatest({p}, 1e-12), 1 - 1e-12))"
_NULL = " + ".join(_LL.format(r=f"r{x}", n=f"n{x}", p="CASE WHEN ra / na <= rc / nc THEN r{0} / n{0} ELSE (ra + rc) / (na + nc) END".format(x)) for x in "ac")


@query("m08_superiority_e", f"""
WITH g AS (SELECT l_suppkey, (count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 25))::DOUBLE AS ra, (count(*) FILTER (WHERE l_returnflag = 'R'))::DOUBLE AS na, (count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity > 25))::DOUBLE AS rc, (count(*) FILTER (WHERE l_returnflag <> 'R'))::DOUBLE AS nc FROM lineitem GROUP BY 1)
SELECT l_suppkey, {_LL.format(r="ra", n="na", p="0.55")} + {_LL.format(r="rc", n="nc", p="0.45")} - ({_NULL}) AS log_e FROM g""")
def m08(spark, d):
    g = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)).alias("ra"), F.count_if(F.col("l_returnflag") == "R").alias("na"), F.count_if((F.col("l_returnflag") != "R") & (F.col("l_quantity") > 25)).alias("rc"), F.count_if(F.col("l_returnflag") != "R").alias("nc"))
    return g.select("l_suppkey", statistics.superiority_log_e("ra", "na", "rc", "nc", F.lit(0.55), F.lit(0.45)).alias("log_e"))


_PROBLEMS = ("title is empty", "the test cannot fail", "pubmed:none is not in the corpus", "malformed citation x", "the seal does not match", "the status needs a seal", "pubmed:mouse is mouse and cannot carry perturbation_in_human")


@query("m17_mechanism_gate", f"SELECT 'm-' || p_partkey AS id, {list(_PROBLEMS)}[p_partkey % 9] AS problem FROM part WHERE p_partkey % 9 BETWEEN 1 AND 7 UNION ALL SELECT 'm-' || p_partkey, 'id must be kebab-case' FROM part WHERE p_partkey < 0")
def m17(spark, d):
    k, lit = F.col("p_partkey") % 9, F.lit
    ref = F.when(k == 3, "pubmed:none").when(k == 4, "x").when(k == 7, "pubmed:mouse").otherwise("pubmed:1")
    test = F.struct(*[F.when(k == 2, lit("same")).otherwise(lit(c)).alias(c) for c in mechanisms.TEST], lit(False).alias("needs_new_data"), lit(None).cast("string").alias("new_data"))
    claims = [F.when((k == 1) & lit(c == "title"), lit(" ")).otherwise(F.concat(lit(c), "p_name")).alias(c) for c in mechanisms.CLAIMS]
    evidence_of = F.array(F.struct(ref.alias("ref"), lit("supports").alias("stance"), lit("perturbation_in_human").alias("causal_level"), lit("it").alias("shows")))
    rival = F.array(F.struct(lit("e").alias("explanation"), lit("d").alias("distinguished_by")))
    rows = load(spark, d, "part").select(F.concat(lit("m-"), "p_partkey").alias("id"), F.when(k == 6, "sealed").otherwise("draft").alias("status"), *claims, F.struct(*[lit(c).alias(c) for c in mechanisms.CONTEXT]).alias("context"), test.alias("test"), evidence_of.alias("evidence"), rival.alias("competing"), lit("2024-02-29").alias("last_reviewed"), "p_partkey")
    seal = F.when(k == 5, F.struct(lit("0").alias("sha256"))).when(k == 8, F.struct(mechanisms.seal_of().alias("sha256")))
    held = spark.createDataFrame([("pubmed:1", "rct"), ("pubmed:mouse", "mouse")], "ref string, level string")
    return mechanisms.problems(rows.withColumn("seal", seal).drop("p_partkey"), ("draft", "sealed"), held, held, {"mouse": ("perturbation_in_human",)})


@query("a20_moderated_t")
def a20(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_partkey").agg((F.avg("l_quantity") - 25).alias("coef"), F.var_samp("l_quantity").alias("s2")).where("s2 > 0")
    return statistics.moderated(rows, "coef", "s2", 10, 0.5)


@query("a30_cluster_bootstrap")
def a30(spark, d):
    return statistics.bootstrap_by_cluster(load(spark, d, "lineitem").select("l_suppkey", "l_quantity"), "l_suppkey", "l_quantity", 200)


@query("a40_pareto_k")
def a40(spark, d):
    rows = load(spark, d, "events").select("event_type", "value")
    return statistics.per_group(rows, ["event_type"], ["value"], lambda p: {"k": pareto_k(p["value"].to_numpy() ** 2)}, "event_type string, k double")


@query("v04_passages")
def v04(spark, d):
    return passages.chunked(load(spark, d, "documents"), "doc_id", "text")


@query("v10_token_windows", "SELECT doc_id, CASE WHEN n_chars <= 510 THEN 1 ELSE ((n_chars - 511) // 256) + 2 END AS windows FROM documents")
def v10(spark, d):
    n = F.col("n_chars")
    starts = F.when(n <= 510, F.array(F.lit(0).cast("long"))).otherwise(F.array_union(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n - 511, F.lit(0)), F.lit(256).cast("long")), lambda s: s < n - 510), F.array(n - 510)))
    return load(spark, d, "documents").select("doc_id", F.size(starts).cast("long").alias("windows"))


@query("c06_countries", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ['United States', 'France'] WHEN 1 THEN ['South Korea'] ELSE ['Türkiye x'] END AS countries FROM supplier")
def c06(spark, d):
    raw = F.expr("CASE s_suppkey % 3 WHEN 0 THEN array('USA', 'Europe', 'United States of America', 'France') WHEN 1 THEN array('Korea, Republic of', 'worldwide') ELSE array('Türkiye  x', '') END")
    return load(spark, d, "supplier").select("s_suppkey", udfs.countries(raw).alias("countries"))


@query("c09_keyword_in_context", r"SELECT doc_id, len(regexp_extract_all(text, 'queen\w*')) AS n FROM documents WHERE contains(text, 'queen')")
def c09(spark, d):
    docs = load(spark, d, "documents").where(F.contains("text", F.lit("queen")))
    return docs.select("doc_id", F.size(udfs.in_context("text", F.lit(r"(?a:queen\w*)"), F.lit(150))).cast("long").alias("n"))


@query("c20_arm_label", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'placebo' ELSE 'active' END AS role, CASE WHEN l_returnflag <> 'N' THEN l_linenumber::DOUBLE END AS dose_value, CASE l_returnflag WHEN 'R' THEN 'BID' WHEN 'A' THEN 'QD' END AS frequency, CASE l_returnflag WHEN 'R' THEN 'topical' WHEN 'A' THEN 'oral' END AS route FROM lineitem")
def c20(spark, d):
    label = F.expr("CASE l_returnflag WHEN 'N' THEN 'Double-Blind Period: Vehicle' WHEN 'R' THEN concat('Agent cream ', l_linenumber, '% BID') ELSE concat('Agent ', l_linenumber, ' mg tablet once daily') END")
    none = F.array().cast("array<string>")
    a = labels.arm(label, none, none, none)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a")).select("l_orderkey", "l_linenumber", "a.role", "a.dose_value", "a.frequency", "a.route")


@query("c25_normal_text", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def c25(spark, d):
    return load(spark, d, "documents").select("doc_id", udfs.normal_text("text").alias("text"))


@query("c26_numbers_in_text", "SELECT s_suppkey, [s_suppkey::DOUBLE, 23.0, 105.0] AS numbers FROM supplier")
def c26(spark, d):
    return load(spark, d, "supplier").select("s_suppkey", udfs.numbers_in(F.concat(F.lit("In "), "s_suppkey", F.lit(" of twenty-three or one hundred and five"))).alias("numbers"))


@query("c31_sentence_at", r"""
WITH p AS (SELECT doc_id, text, regexp_replace(left(text, 40), '(?s)^.*[.!?]\s+', '') AS head, substr(text, 41) AS rest FROM documents)
SELECT doc_id, CASE WHEN len(text) > 40 THEN trim(head || CASE WHEN regexp_matches(rest, '(?s)[.!?](\s|$)') THEN regexp_extract(rest, '(?s)^(.*?[.!?])(?:\s|$)', 1) ELSE rest END, ' ' || chr(9) || chr(10) || chr(13)) END AS sentence FROM p""")
def c31(spark, d):
    return load(spark, d, "documents").select("doc_id", udfs.sentence_at("text", F.lit(40)).alias("sentence"))


@query("j18_lexicon_annotation", r"""
SELECT doc_id, len(regexp_extract_all(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), '  ') || ' ', ' (the  and|and  the|of  the|que  la|the) ')) AS n FROM documents""")
def j18(spark, d):
    lexicon = F.array(*[F.lit(x) for x in ("the and", "the", "and the", "of the", "que la")])
    return load(spark, d, "documents").select("doc_id", F.size(udfs.longest_terms("text", lexicon)).alias("n"))


@query("e01_reported_with_comparator", """
WITH r AS (SELECT l_suppkey AS source_id, l_partkey % 40 AS agent, l_quantity AS n, l_discount AS pct, l_orderkey * 10 + l_linenumber AS o, CASE WHEN l_returnflag = 'N' THEN 'placebo' ELSE 'active' END AS role FROM lineitem), p AS (SELECT *, max(n) OVER (PARTITION BY source_id, agent, role) AS peak FROM r),
c AS (SELECT source_id, pct AS cp, n AS cn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, o) AS k FROM p WHERE role = 'placebo') WHERE k = 1), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent, source_id ORDER BY n DESC, o) AS k FROM p WHERE role = 'active' AND n >= peak * 0.8) WHERE k = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY n DESC, o) AS m, count(*) OVER (PARTITION BY agent) - 1 AS others FROM t) SELECT agent, source_id, pct AS percent, n AS n_analyzed, others, cp AS control_percent, pct - cp AS difference FROM b LEFT JOIN c USING (source_id) WHERE m = 1""")
def e01(spark, d):
    role = F.when(F.col("l_returnflag") == "N", "placebo").otherwise("active")
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.concat(role, (F.col("l_partkey") % 40).cast("string")).alias("arm_label"), F.lit("T-75").alias("endpoint"), F.lit(None).cast("string").alias("assessor"), (F.col("l_partkey") % 40).alias("agent"), F.lit(1.0).alias("dose_value"), F.col("l_quantity").alias("n_analyzed"), F.col("l_discount").alias("percent"), role.alias("arm_role"), F.lit(24).alias("week"), F.lit("PRIMARY").alias("outcome_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    out = evidence.reported_with_comparator(rows)
    return out.select("agent", "source_id", "percent", "n_analyzed", F.size("others").cast("long").alias("others"), "control_percent", "difference")


@query("s01_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def s01(spark, d):
    return events.tumbling(load(spark, d, "events"))


@query("s02_sliding", "SELECT start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start, event_type FROM events) GROUP BY 1, 2")
def s02(spark, d):
    return events.sliding(load(spark, d, "events"))


@query("s03_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def s03(spark, d):
    return events.sessions(load(spark, d, "events"))


@query("s04_rate_limiter")
def s04(spark, d):
    return events.rate_limited(load(spark, d, "events"), 2, 3600.0)


@query("s05_sliding_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def s05(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return load(spark, d, "events").select("event_id", F.count("*").over(w).alias("n"))
