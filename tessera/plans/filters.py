"""Queries over filters and gates (inventory F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import evidence, publications, ranking, search
from tessera.plans.registry import load, query


@query("f01_filter_conjunction", """
SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND lower(o_orderpriority) = '1-urgent' AND o_totalprice > 100000 AND o_orderkey % 2 = 0""")
def f01(spark, d):
    o = load(spark, d, "orders")
    trials = o.select("o_orderkey", F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("status"), (F.col("o_totalprice") > 100000).alias("has_results"), F.array(F.when(F.col("o_orderkey") % 2 == 0, F.lit("Phase2")).otherwise(F.lit("Phase3"))).alias("phases"))
    return search.filtered(trials, sources=["F", "O"], status="1-Urgent", phase="PHASE2", has_results=True).select("o_orderkey")


@query("f02_any_field", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ree_') OR contains(lower(lang), 'de') OR contains(lower(source), 'src1')")
def f02(spark, d):
    docs = load(spark, d, "documents")
    return docs.where(search.contains_any(["text"], "ree_") | search.contains_any(["lang"], "DE") | search.contains_any(["source"], "src1")).select("doc_id")


@query("f03_word_start", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])non[\s\-]?seg') OR regexp_matches(lower(text), '(^|[^a-z0-9])reth')")
def f03(spark, d):
    t = F.lower("text")
    return load(spark, d, "documents").where(t.rlike(text.token_pattern("non-seg")) | t.rlike(text.token_pattern("reth"))).select("doc_id")


@query("f04_page_with_count", """
WITH f AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, (SELECT count(*) FROM f) AS total FROM f ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20""")
def f04(spark, d):
    f = load(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return search.page(f, [F.desc("o_orderdate"), F.desc("o_orderkey")], 20, 20).select("o_orderkey").withColumn("total", f.agg(F.count("*")).scalar())


@query("f05_minimum_score", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 1000 ORDER BY s_acctbal DESC, s_suppkey LIMIT 30")
def f05(spark, d):
    return load(spark, d, "supplier").where("s_acctbal >= 1000").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(30).select("s_suppkey", "s_acctbal")


@query("f06_entity_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') ORDER BY c_name, c_custkey LIMIT 25")
def f06(spark, d):
    name = F.col("c_name")
    hit = (text.entity_key(name) == text.entity_key(F.lit("00001"))) | F.contains(F.lower(name), F.lit("00001"))
    return load(spark, d, "customer").where(hit).orderBy("c_name", "c_custkey").limit(25).select("c_custkey", "c_name")


@query("f07_relevance_gate", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'licensed under') OR (regexp_matches(lower(text), 'the and') AND NOT regexp_matches(lower(text), 'idiot|clown'))")
def f07(spark, d):
    return load(spark, d, "documents").where(evidence.relevant(F.lower("text"), "licensed under", "the and", "idiot|clown")).select("doc_id")


@query("f08_scope_predicate", "SELECT event_id FROM events WHERE (props ->> '$.k')::INTEGER NOT IN (1, 2, 3)")
def f08(spark, d):
    return load(spark, d, "events").where(~F.try_variant_get(F.try_parse_json("props"), "$.k", "int").isin(1, 2, 3)).select("event_id")


@query("f09_relation_classifier", "SELECT CASE WHEN p_type = 'LARGE' OR p_brand LIKE '%2' THEN 'close' WHEN p_type IN ('PROMO', 'SMALL') THEN 'class_safety' ELSE 'distant' END AS relation, count(*) AS n FROM part GROUP BY 1")
def f09(spark, d):
    relation = publications.class_relation(F.array(F.col("p_type"), F.when(F.endswith(F.col("p_brand"), F.lit("2")), "Very-Large thing")), ("large",), ("promo", "small"))
    return load(spark, d, "part").groupBy(relation.alias("relation")).agg(F.count("*").alias("n"))


@query("f10_population_gate", """
SELECT doc_id, doc_id % 4 IN (0, 2) OR doc_id % 8 = 3 AS verdict, CASE WHEN doc_id % 4 = 1 THEN 'title names another condition' WHEN doc_id % 4 IN (0, 2) THEN 'title names the topic' WHEN doc_id % 8 = 3 THEN 'abstract names them as subjects' ELSE 'none' END AS rule FROM documents""")
def f10(spark, d):
    title = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Outcomes in Topicosis and melanoma' WHEN 1 THEN 'Melanoma after topicosis' WHEN 2 THEN 'On topicosis' ELSE 'A study' END")
    # A sentence of its own: after a text that ends with "in", the bare word would name subjects.
    abstract = F.concat(F.coalesce("text", F.lit("")), F.expr("CASE doc_id % 8 WHEN 3 THEN '. patients  with topicosis' ELSE '. topicosis' END"))
    gate = publications.studies_topic(title, abstract, ("topicosis",), ("melanoma",))
    return load(spark, d, "documents").select("doc_id", gate.alias("g")).select("doc_id", "g.verdict", "g.rule")


_RULES = ("type rules it out", "about trials", "not in people", "title names a design", "no treatment studied", "type rules it in", "title names no treatment", "abstract", "abstract", "title compares", "none")


@query("f11_reports_a_trial", f"SELECT doc_id, doc_id % 11 IN (3, 5, 7, 9) AS verdict, {list(_RULES)}[1 + doc_id % 11] AS rule FROM documents")
def f11(spark, d):
    title = F.expr("array('A randomised cream', 'Lessons of trials', 'Cream in mice', 'A Double-Blind study', 'Prevalence of use of a cream', 'Notes', 'Notes', 'A cream for all', 'A cream for all', 'Cream versus tablet', 'A cream alone')[doc_id % 11]")
    types = F.expr("CASE doc_id % 11 WHEN 0 THEN array('Review') WHEN 5 THEN array('Clinical Trial') WHEN 4 THEN array('Clinical Trial') END")
    abstract = F.concat(F.col("text"), F.expr("CASE doc_id % 11 WHEN 7 THEN ' were randomly assigned.' ELSE '.' END"))
    abstract = F.when(F.col("doc_id") % 11 < 9, abstract)
    told = publications.reports_a_trial(title, abstract, types)
    return load(spark, d, "documents").select("doc_id", told.alias("t")).select("doc_id", "t.verdict", "t.rule")


@query("f12_observational_gate", "SELECT doc_id, doc_id % 3 = 0 AND doc_id % 2 = 0 AS outcome, CASE WHEN doc_id % 3 = 1 AND doc_id % 2 = 1 THEN 'retrospective' ELSE 'prospective_or_unstated' END AS design FROM documents")
def f12(spark, d):
    title = F.expr("CASE doc_id % 3 WHEN 0 THEN 'Randomized vaccine in melanoma' WHEN 1 THEN 'A chart-review' ELSE 'Vaccine in melanoma' END")
    abstract = F.concat(F.col("text"), F.expr("CASE doc_id % 2 WHEN 0 THEN ' topicosis followed, a prospective finding' ELSE '' END"))
    outcome = publications.topic_as_outcome(title, abstract, F.lit(None).cast("array<string>"), ("topicosis",), ("melanoma",), ("vaccine",))
    return load(spark, d, "documents").select("doc_id", outcome.alias("outcome"), publications.design_of(title, abstract).alias("design"))


_TYPES = "CASE doc_id % 9 WHEN 0 THEN 'Meta-Analysis' WHEN 1 THEN 'Systematic Review' WHEN 2 THEN 'Randomized Controlled Trial' WHEN 3 THEN 'Case Reports' WHEN 4 THEN 'Review' WHEN 5 THEN 'Observational Study' WHEN 6 THEN 'Clinical Trial' WHEN 7 THEN 'Journal Article' END"


@query("f13_evidence_level", """
SELECT doc_id, CASE WHEN source = 'src3' THEN CASE WHEN doc_id % 2 = 0 THEN 'mouse' ELSE 'other' END ELSE CASE doc_id % 9 WHEN 0 THEN 'meta_analysis' WHEN 1 THEN 'systematic_review' WHEN 2 THEN 'rct' WHEN 3 THEN 'case_report' WHEN 4 THEN 'review' WHEN 5 THEN 'cohort' WHEN 6 THEN 'rct' WHEN 7 THEN 'mouse' ELSE 'unknown' END END AS level FROM documents""")
def f13(spark, d):
    types = F.array_compact(F.array(F.expr(_TYPES)))
    mesh = F.when(F.col("doc_id") % 9 == 7, F.array(F.lit("Mice, Knockout"))).otherwise(F.array().cast("array<string>"))
    abstract = F.when(F.col("doc_id") % 9 == 6, F.lit("patients were randomised")).otherwise(F.lit(""))
    keywords = F.array(F.expr("CASE doc_id % 2 WHEN 0 THEN 'Mus musculus' ELSE 'Homo sapiens' END"))
    level = evidence.document_level(F.lit("title"), abstract, types, mesh, F.expr("CASE source WHEN 'src3' THEN 'geo' ELSE source END"), F.lit("journal"), keywords)
    return load(spark, d, "documents").select("doc_id", level.alias("level"))


@query("f14_trial_level", "SELECT CASE o_orderstatus WHEN 'O' THEN 'cohort' WHEN 'F' THEN 'clinical_trial' ELSE 'unknown' END AS level, count(*) AS n FROM orders GROUP BY 1")
def f14(spark, d):
    kind = F.expr("CASE o_orderstatus WHEN 'O' THEN 'observational' WHEN 'F' THEN 'Interventional' END")
    return load(spark, d, "orders").groupBy(evidence.trial_level(kind).alias("level")).agg(F.count("*").alias("n"))


@query("f15_usable_rows", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag AS instrument, l_quantity AS n, l_linenumber * 12 AS week, CASE WHEN l_linestatus = 'F' AND l_suppkey % 2 = 0 THEN 'central' END AS assessor, l_shipmode FROM (SELECT *, CASE l_linenumber % 5 WHEN 0 THEN 'x' ELSE 'y' END AS l_shipmode FROM lineitem)),
c AS (SELECT *, max(CASE WHEN assessor = 'central' THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey, instrument) AS central FROM r)
SELECT l_orderkey, l_linenumber FROM c WHERE l_shipmode <> 'x' AND (central = 0 OR assessor = 'central') AND (l_suppkey % 3 <> 0 OR week <= 36) AND n >= 20""")
def f15(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("instrument"), F.col("l_quantity").alias("n_analyzed"), (F.col("l_linenumber") * 12).alias("week"), F.lit(50.0).alias("percent"), F.expr("CASE WHEN l_linestatus = 'F' AND l_suppkey % 2 = 0 THEN 'central' END").alias("assessor"), F.expr("CASE l_linenumber % 5 WHEN 0 THEN array('open_label') ELSE array('other') END").alias("flags"))
    caps = load(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("source_id"), F.lit(36).alias("cap"))
    return evidence.usable_rows(rows, caps, ("open_label", "week_ambiguous"), 20).select("l_orderkey", "l_linenumber")


@query("f16_retention", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey) AS peak FROM orders) WHERE o_totalprice >= peak * 0.8")
def f16(spark, d):
    return ranking.retained(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 0.8).select("o_orderkey")


@query("f17_comparable_population", """
WITH r AS (SELECT event_id, user_id AS s, event_id % 60 AS week, event_type AS pop, event_id % 2 = 0 AS prim FROM events), st AS (SELECT * FROM r WHERE pop <> 'view'), k AS (SELECT s, pop AS anchor, row_number() OVER (PARTITION BY s ORDER BY abs(week - 24), CASE WHEN prim THEN 0 ELSE 1 END, week, pop) AS n FROM st WHERE pop <> 'error')
SELECT event_id FROM r LEFT JOIN (SELECT s, anchor FROM k WHERE n = 1) a USING (s) WHERE pop <> 'error' AND (anchor IS NULL OR pop = 'view' OR pop = anchor)""")
def f17(spark, d):
    rows = load(spark, d, "events").select("event_id", F.col("user_id").alias("source_id"), (F.col("event_id") % 60).alias("week"), F.expr("CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 'subgroup' ELSE event_type END").alias("population"), F.expr("CASE event_id % 2 WHEN 0 THEN 'PRIMARY' ELSE 'SECONDARY' END").alias("outcome_type"))
    return evidence.comparable(rows, evidence.anchor_populations(rows)).select("event_id")


@query("f18_control_exclusion", "SELECT p_partkey FROM part WHERE NOT regexp_matches(lower(p_type), 'promo|small')")
def f18(spark, d):
    return load(spark, d, "part").where(~F.lower("p_type").rlike("promo|small")).select("p_partkey")


@query("f19_licence_filter", "SELECT event_id, list_filter([event_type || ':a', 'open:b'], lambda x: NOT starts_with(x, 'view') AND NOT starts_with(x, 'error')) AS evidence, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS n_ids FROM events")
def f19(spark, d):
    rows = load(spark, d, "events").select("event_id", F.array(F.concat("event_type", F.lit(":a")), F.lit("open:b")).alias("ev"), F.create_map(F.col("event_type"), F.lit("1"), F.lit("k"), F.lit("2")).alias("ids"))
    return rows.select("event_id", evidence.public_evidence(F.col("ev"), ("view", "error")).alias("evidence"), F.size(evidence.public_ids(F.col("ids"), ("click",))).alias("n_ids"))


@query("f20_topic_centred", "SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR len(regexp_extract_all(lower(text), 'the')) >= 2")
def f20(spark, d):
    source, body = F.col("source"), F.col("text")
    return load(spark, d, "documents").where(F.contains(F.lower(source), F.lit("src1")) | evidence.centred(F.lit(""), body, "the")).select("doc_id")


@query("f21_sample_relevance", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS series, bool_or(contains(url, '/en/') AND page_id % 2 = 0) AS relevant, count(*) AS samples FROM pages GROUP BY 1")
def f21(spark, d):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    none = F.lit(None).cast("string")
    samples = load(spark, d, "pages").select(host.alias("series"), none.alias("series_title"), none.alias("title"), F.lit("skin").alias("source_name"), F.create_map(F.when(F.col("page_id") % 2 == 0, "disease").otherwise("note"), F.upper("url")).alias("characteristics"))
    return publications.relevant_series(samples, "/EN/", ("disease", "phenotype"))


@query("f22_trusted_claims", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' OR (l_returnflag = 'R' AND l_linestatus = 'F') GROUP BY 1, 2")
def f22(spark, d):
    claims = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("subject"), F.expr("CASE l_returnflag WHEN 'R' THEN 'treats' WHEN 'A' THEN 'combined_with' ELSE 'inhibits' END").alias("predicate"), F.col("l_linestatus").alias("object"), "l_returnflag", "l_linestatus")
    return publications.trusted_claims(claims, ("combined_with",), {"treats": "F"}).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
