"""Queries over column functions (inventory C1-C46)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import stats, text, vector
from tessera.plans.registry import load, query


@query("c01_entity_key", """
SELECT c_custkey, coalesce(nullif(trim(left(trim(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '_', 'g'), '_'), 120), '_'), ''), 'unknown') AS key FROM customer""")
def c01(spark, d):
    return load(spark, d, "customer").select("c_custkey", text.entity_key(F.col("c_name")).alias("key"))


@query("c02_coerce_kind", """
SELECT event_id, CASE WHEN k IN ('drug', 'target') THEN k WHEN k IN ('gene', 'protein') THEN 'target' WHEN k IN ('medication', 'compound') THEN 'drug' WHEN k = 'condition' THEN 'disease' END AS kind
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'gene' WHEN 'click' THEN 'drug' WHEN 'purchase' THEN 'compound' WHEN 'signup' THEN 'condition' ELSE event_type END AS k FROM events)""")
def c02(spark, d):
    raw = F.expr("CASE event_type WHEN 'view' THEN ' Gene' WHEN 'click' THEN 'drug' WHEN 'purchase' THEN 'Compound' WHEN 'signup' THEN 'condition ' ELSE event_type END")
    return load(spark, d, "events").select("event_id", text.coerce_kind(raw, ("drug", "target")).alias("kind"))


@query("c03_drug_token", r"""
WITH w AS (SELECT p_partkey, p_name, list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '' AND x NOT IN ('placebo','cream','topical','oral','phosphate','tablet','capsule','anhydrous','propionate','cream bid')) AS ws FROM part)
SELECT p_partkey, coalesce(list_filter(ws, lambda x: len(x) >= 4)[1], ws[1], lower(p_name)) AS token FROM w""")
def c03(spark, d):
    return load(spark, d, "part").select("p_partkey", text.drug_token(F.col("p_name")).alias("token"))


@query("c04_trial_stage", """
WITH p AS (SELECT o_orderkey, o_orderkey % 4 + 1 AS a, o_orderkey % 3 + 1 AS b FROM orders)
SELECT o_orderkey, CASE WHEN least(a,b) = 2 AND greatest(a,b) = 3 THEN 'PHASE_2_3' WHEN least(a,b) = 1 AND greatest(a,b) = 2 THEN 'PHASE_1_2' ELSE 'PHASE_' || greatest(a,b) END AS stage FROM p""")
def c04(spark, d):
    phases = F.array(F.concat(F.lit("PHASE"), F.col("o_orderkey") % 4 + 1), F.concat(F.lit("phase"), F.col("o_orderkey") % 3 + 1))
    return load(spark, d, "orders").select("o_orderkey", text.trial_stage(phases).alias("stage"))


@query("c05_stage_rank", """
SELECT o_orderpriority, count(*) AS n, max(CASE left(o_orderpriority, 1) WHEN '1' THEN 8 WHEN '2' THEN 7 WHEN '3' THEN 6 WHEN '4' THEN 4 ELSE 0 END) AS rank FROM orders GROUP BY 1""")
def c05(spark, d):
    stage = F.expr("CASE left(o_orderpriority, 1) WHEN '1' THEN 'approval' WHEN '2' THEN 'PHASE_4' WHEN '3' THEN 'phase_3' WHEN '4' THEN 'PHASE_2' END")
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max(text.stage_rank(stage)).alias("rank"))


@query("c08_registry_ids", r"""
SELECT doc_id, unnest(regexp_extract_all(t, '(?i)ISRCTN\d{8}')) AS identifier, 'ISRCTN' AS registry FROM (SELECT doc_id, text || ' ISRCTN' || (10000000 + doc_id) AS t FROM documents)
UNION ALL SELECT doc_id, 'DRKS' || (20000000 + doc_id), 'DRKS (Germany)' FROM documents""")
def c08(spark, d):
    t = F.concat("text", F.lit(" ISRCTN"), (F.col("doc_id") + 10000000).cast("string"), F.lit(" drks"), (F.col("doc_id") + 20000000).cast("string"))
    return load(spark, d, "documents").select("doc_id", F.explode(text.registry_ids(t)).alias("x")).select("doc_id", "x.identifier", "x.registry")


@query("c10_compare_key", "SELECT p_partkey, upper(regexp_replace(p_brand || '/' || p_type, '[^A-Za-z0-9]', '', 'g')) AS key FROM part")
def c10(spark, d):
    return load(spark, d, "part").select("p_partkey", text.compare_key(F.concat_ws("/", "p_brand", "p_type")).alias("key"))


@query("c12_redact", r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.-]+', '[email removed]', 'g'), '(?i)\b((?:tel|phone|mobile|fax)[.:]*\s*)\+?[0-9][0-9 ()./-]{5,}[0-9]', '\1[phone removed]', 'g') AS text FROM documents""")
def c12(spark, d):
    return load(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


@query("c13_title_key", "SELECT regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def c13(spark, d):
    return load(spark, d, "documents").groupBy(text.title_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("c14_paper_key", """
SELECT doc_id, CASE WHEN source = 'src0' THEN doc_id::VARCHAR WHEN source = 'src1' AND doc_id % 3 > 0 THEN (doc_id * 7)::VARCHAR ELSE CASE source WHEN 'src1' THEN 'pmc' ELSE source END || ':' || doc_id END AS key FROM documents""")
def c14(spark, d):
    source = F.expr("CASE source WHEN 'src0' THEN 'pubmed' WHEN 'src1' THEN 'pmc' ELSE source END")
    pmid = F.expr("CASE doc_id % 3 WHEN 0 THEN 'n/a' ELSE string(doc_id * 7) END")
    return load(spark, d, "documents").select("doc_id", text.paper_key(source, F.col("doc_id").cast("string"), pmid).alias("key"))


@query("c15_json_path", "SELECT event_id, (props ->> '$.k')::INTEGER AS k FROM events")
def c15(spark, d):
    return load(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


_AGENTS = {"anodized": ("plated", "burnished"), "steel": ("tin",), "brushed": ()}


@query("c16_alias_matcher", r"""
SELECT p_partkey, list_filter([CASE WHEN regexp_matches(t, '(^|[^a-z0-9])(anodized|plated|burnished)($|[^a-z0-9])') THEN 'anodized' END, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])(steel|tin)($|[^a-z0-9])') THEN 'steel' END, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])brushed($|[^a-z0-9])') THEN 'brushed' END], lambda x: x IS NOT NULL) AS agents
FROM (SELECT p_partkey, lower(p_type) AS t FROM part)""")
def c16(spark, d):
    return load(spark, d, "part").select("p_partkey", text.match_aliases(F.col("p_type"), _AGENTS).alias("agents"))


@query("c17_outcome_tags", r"""
SELECT doc_id, list_filter([CASE WHEN regexp_matches(t, '(?i)vasi|repigment|depigment|lesion area') THEN 'repigmentation' END, CASE WHEN regexp_matches(t, '(?i)\bvns\b|noticeab|vitiqol|dlqi|quality of life|patient global|pgic|questionnaire') THEN 'patient_reported' END,
 CASE WHEN regexp_matches(t, '(?i)adverse|safety|tolerab|laboratory|vital sign|ecg') THEN 'safety' END, CASE WHEN regexp_matches(t, '(?i)pharmacokinetic|plasma concentration|\bcmax\b|\bauc\b') THEN 'pharmacokinetics' END, CASE WHEN regexp_matches(t, '(?i)biomarker|cxcl|chemokine|gene expression') THEN 'biomarker' END], lambda x: x IS NOT NULL) AS tags
FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' DLQI' WHEN 1 THEN ' adverse Cmax' ELSE '' END AS t FROM documents)""")
def c17(spark, d):
    t = F.concat("text", F.expr("CASE doc_id % 4 WHEN 0 THEN ' DLQI' WHEN 1 THEN ' adverse Cmax' ELSE '' END"))
    return load(spark, d, "documents").select("doc_id", text.tags(t).alias("tags"))


@query("c18_endpoint", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN 'VNS' WHEN l_linenumber = 3 THEN NULL WHEN l_returnflag = 'R' THEN 'F-VASI' ELSE 'T-VASI' END AS instrument,
 CASE WHEN l_linenumber IN (3, 4) THEN NULL ELSE (25 * (l_linenumber % 3 + 1))::INTEGER END AS threshold,
 CASE WHEN l_linenumber = 4 THEN 'face' WHEN l_linenumber = 3 THEN NULL WHEN l_returnflag = 'R' THEN 'face' ELSE 'total body' END AS region FROM lineitem""")
def c18(spark, d):
    title = F.expr("CASE l_linenumber WHEN 4 THEN 'VNS responders, facial' WHEN 3 THEN 'Percentage with F-VASI25/50/75' ELSE concat('Participants achieving ', CASE l_returnflag WHEN 'R' THEN 'F' ELSE 'T' END, '-VASI', 25 * (l_linenumber % 3 + 1), ' at Week 24') END")
    e = text.endpoint(title, F.lit(None).cast("string"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", e["instrument"].alias("instrument"), e["threshold"].alias("threshold"), e["region"].alias("region"))


@query("c19_week", """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 52 END AS week, CASE l_linenumber % 4 WHEN 0 THEN 'row_label' WHEN 1 THEN 'outcome_title' WHEN 2 THEN 'time_frame' END AS week_source FROM lineitem""")
def c19(spark, d):
    k = "l_linenumber % 4"
    w = text.week(F.expr(f"CASE {k} WHEN 0 THEN ' Week 12 ' END"), F.expr(f"CASE {k} WHEN 1 THEN 'Response at Week 24' WHEN 3 THEN 'Weeks 4, 8, and 24' ELSE 'Response' END"), F.expr(f"CASE {k} WHEN 2 THEN 'Baseline, Week 52' WHEN 3 THEN 'up to Week 48' ELSE 'Week 4' END"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", w["week"].alias("week"), w["week_source"].alias("week_source"))


@query("c21_analysis_population", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'subgroup' WHEN 1 THEN 'as_observed' WHEN 2 THEN 'nri' WHEN 3 THEN 'multiple_imputation' END AS population FROM orders""")
def c21(spark, d):
    text_of = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'A subset of participants, only participants with available data' WHEN 1 THEN 'Only participants with available data; non-responder imputation' WHEN 2 THEN 'Non-responder imputation' WHEN 3 THEN 'Imputed by multiple imputation' ELSE ' ' END")
    return load(spark, d, "orders").select("o_orderkey", text.analysis_population(text_of).alias("population"))


@query("c22_value_as_rate", """
SELECT l_orderkey, l_linenumber,
 CASE l_linenumber % 3 WHEN 0 THEN 100.0 * l_quantity / 50 WHEN 1 THEN 100.0 * l_discount ELSE l_quantity END AS percent,
 CASE l_linenumber % 3 WHEN 0 THEN l_quantity::INTEGER WHEN 1 THEN round_even(l_discount * 50, 0)::INTEGER ELSE round_even(l_quantity * 50 / 100.0, 0)::INTEGER END AS responders,
 l_linenumber % 3 <> 0 AS derived FROM lineitem""")
def c22(spark, d):
    k = "l_linenumber % 3"
    v = text.value_as_rate(F.expr(f"CASE {k} WHEN 1 THEN l_discount ELSE l_quantity END"), F.lit(50), F.expr(f"CASE {k} WHEN 0 THEN 'count_of_participants' ELSE 'NUMBER' END"), F.expr(f"CASE {k} WHEN 1 THEN 'Proportion of participants' ELSE 'percentage' END"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v["percent"].alias("percent"), v["responders"].alias("responders"), v["derived"].alias("derived"))


@query("c23_daily_dose", "SELECT l_orderkey, l_linenumber, l_quantity * CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS dose FROM lineitem")
def c23(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stats.daily_dose(F.col("l_quantity"), F.expr("CASE l_returnflag WHEN 'R' THEN 'BID' WHEN 'A' THEN 'QD' END")).alias("dose"))


@query("c24_printed_cell", """
SELECT s_suppkey, (s_suppkey % 30)::INTEGER AS responders, (30 + s_suppkey % 9)::INTEGER AS n, (10 + s_suppkey % 50 + 0.5)::DOUBLE AS percent FROM supplier WHERE s_suppkey % 4 < 3""")
def c24(spark, d):
    r, n, p = "s_suppkey % 30", "30 + s_suppkey % 9", "10 + s_suppkey % 50"
    cell = F.expr(f"CASE s_suppkey % 4 WHEN 0 THEN concat({r}, '/', {n}, ' (', {p}, '.5)') WHEN 1 THEN concat('(n = ', {n}, ') ', {r}, ' (', {p}, '.5%)') WHEN 2 THEN concat({r}, ' (', {p}, '.5%)') ELSE 'not reported' END")
    got = load(spark, d, "supplier").select("s_suppkey", text.printed_cell(cell, F.expr(f"concat('Cream (n = ', {n}, ')')")).alias("x"))
    return got.where("x IS NOT NULL").select("s_suppkey", "x.responders", "x.n", "x.percent")


@query("c27_gene_list", r"""
SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(replace(p_type, ' ', ' - ') || ', HLA-DRB1', '\s+-\s+|\s*,\s*'), lambda x: trim(x)), lambda x: regexp_full_match(x, '(?i)[A-Z0-9][A-Z0-9._-]{1,19}')) AS genes FROM part""")
def c27(spark, d):
    return load(spark, d, "part").select("p_partkey", text.gene_list(F.concat(F.replace(F.col("p_type"), F.lit(" "), F.lit(" - ")), F.lit(", HLA-DRB1"))).alias("genes"))


@query("c28_stem_subset", r"""
WITH s AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: CASE WHEN len(w) > 4 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|is|us)$') THEN left(w, len(w) - 1) ELSE w END)) AS stems FROM documents)
SELECT doc_id, len(stems) AS n_stems, list_has_all(stems, ['the', 'and']) AS has_both FROM s""")
def c28(spark, d):
    stems = load(spark, d, "documents").select("doc_id", text.stem_set(F.regexp_replace("text", "'", " ")).alias("stems"))
    return stems.select("doc_id", F.size("stems").alias("n_stems"), text.subset_of(text.stem_set(F.lit("And the")), F.col("stems")).alias("has_both"))


@query("c29_action_predicate", """
SELECT event_type, count(*) AS n, min(CASE event_type WHEN 'view' THEN 'inhibits' WHEN 'click' THEN 'activates' ELSE 'targets' END) AS plain,
 min(CASE event_type WHEN 'view' THEN 'inhibits' WHEN 'click' THEN 'activates' WHEN 'purchase' THEN 'activates' WHEN 'signup' THEN 'targets' END) AS release FROM events GROUP BY 1""")
def c29(spark, d):
    action = F.expr("CASE event_type WHEN 'view' THEN 'Kinase inhibitor' WHEN 'click' THEN 'AGONIST' WHEN 'purchase' THEN 'unknown' WHEN 'signup' THEN 'Modulator' ELSE 'other' END")
    assay = F.expr("CASE event_type WHEN 'purchase' THEN 'ec50' ELSE 'IC50' END")
    value = F.expr("CASE event_type WHEN 'purchase' THEN 7.5 ELSE 2.0 END")
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(text.action_predicate(action)).alias("plain"), F.min(text.action_relation(action, assay, value)).alias("release"))


@query("c32_snippet", r"""
WITH b AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents)
SELECT doc_id, CASE WHEN len(body) <= 320 THEN body ELSE CASE WHEN strpos(left(body, 320), ' ') > 1 THEN regexp_replace(left(body, 320), ' [^ ]*$', '') ELSE left(body, 320) END || '…' END AS snippet FROM b""")
def c32(spark, d):
    return load(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("c33_title_and_abstract", r"SELECT doc_id, concat_ws(chr(10) || chr(10), nullif(trim(source), ''), CASE WHEN doc_id % 2 = 0 THEN nullif(trim(text), '') END) AS body FROM documents")
def c33(spark, d):
    abstract = F.when(F.col("doc_id") % 2 == 0, F.col("text"))
    return load(spark, d, "documents").select("doc_id", text.title_and_abstract(F.col("source"), abstract).alias("body"))


@query("c34_fingerprint", "SELECT doc_id, sha256(text) AS sha FROM documents")
def c34(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("c35_sponsor_key", r"""
WITH k AS (SELECT s_suppkey, s_name, array_to_string(regexp_extract_all(lower(s_name || CASE s_suppkey % 3 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Co. Ltd' ELSE '' END), '[a-z0-9]+'), ' ') AS w FROM supplier)
SELECT s_suppkey, regexp_replace(w, '( (co|corp|corporation|inc|llc|ltd|limited))+$', '') AS key FROM k""")
def c35(spark, d):
    name = F.concat("s_name", F.expr("CASE s_suppkey % 3 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Co. Ltd' ELSE '' END"))
    return load(spark, d, "supplier").select("s_suppkey", text.sponsor_key(name).alias("key"))


@query("c36_vector_norms", "SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm, len(embedding) AS dim FROM embeddings")
def c36(spark, d):
    return load(spark, d, "embeddings").select("vec_id", vector.norm(F.col("embedding")).alias("norm"), F.size("embedding").alias("dim"))


@query("c37_jeffreys_logit", """
WITH r AS (SELECT source, count(*) AS n, sum(toxic) AS r FROM documents JOIN labels USING (doc_id) GROUP BY source), j AS (SELECT source, (r + 0.5) / (n + 1.0) AS rate FROM r)
SELECT source, rate, ln(rate / (1 - rate)) AS logit, 1 / (1 + exp(-ln(rate / (1 - rate)))) AS back FROM j""")
def c37(spark, d):
    both = load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels"), "doc_id")
    rate = both.groupBy("source").agg(stats.jeffreys_rate(F.sum("toxic"), F.count("*")).alias("rate"))
    return rate.withColumn("logit", stats.logit(F.col("rate"))).withColumn("back", stats.expit(F.col("logit")))


@query("c38_bounds", """
WITH g AS (SELECT source, count(*) AS grp, count(toxic) AS analysed, coalesce(sum(toxic), 0) AS r FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, 100.0 * r / analysed AS reported, 100.0 * r / grp AS floor, 100.0 * (r + grp - analysed) / grp AS ceiling, 100.0 * (r + grp - analysed) / grp - 100.0 * r / grp AS width, grp = analysed AS identified, 100.0 * r / grp <= 20 AND 20 <= 100.0 * (r + grp - analysed) / grp AS covers_20 FROM g WHERE analysed > 0""")
def c38(spark, d):
    both = load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels"), "doc_id", "left")
    g = both.groupBy("source").agg(F.count("*").alias("grp"), F.count("toxic").alias("analysed"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("r"))
    b = g.select("source", stats.bounds(F.col("r"), F.col("analysed"), F.col("grp")).alias("b")).where("b IS NOT NULL")
    return b.select("source", "b.*", stats.covers(F.col("b"), F.lit(20.0)).alias("covers_20"))


@query("c39_edge_weight", """
WITH e AS (SELECT event_id, least(value / 100, 1.0) AS c, CASE event_type WHEN 'view' THEN 'CHANGES' WHEN 'click' THEN 'TREATS' WHEN 'purchase' THEN 'TARGETS' ELSE 'ASSOCIATED_WITH' END AS p, event_id % 2 = 0 AS obs, CASE event_id % 3 WHEN 0 THEN 'human_genetics' WHEN 1 THEN 'other' END AS lvl FROM events)
SELECT event_id, CASE WHEN p = 'CHANGES' THEN 0.20 WHEN p IN ('TREATS', 'TARGETS') THEN CASE WHEN obs THEN CASE p WHEN 'TREATS' THEN 1.0 ELSE 0.90 END ELSE greatest(0.65, c * 0.90) END WHEN obs THEN CASE WHEN lvl = 'human_genetics' THEN 0.75 ELSE greatest(0.65, c) END ELSE greatest(0.20, c * 0.50) END::DOUBLE AS weight FROM e""")
def c39(spark, d):
    e = load(spark, d, "events")
    p = F.expr("CASE event_type WHEN 'view' THEN 'CHANGES' WHEN 'click' THEN 'TREATS' WHEN 'purchase' THEN 'TARGETS' ELSE 'ASSOCIATED_WITH' END")
    claim, level = F.expr("CASE event_id % 2 WHEN 0 THEN 'observed' END"), F.expr("CASE event_id % 3 WHEN 0 THEN 'human_genetics' WHEN 1 THEN 'other' END")
    return e.select("event_id", stats.edge_weight(claim, level, F.least(F.col("value") / 100, F.lit(1.0)), p).alias("weight"))


@query("c40_binomial_log_score", """
SELECT s_suppkey, lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1) + CASE WHEN r > 0 THEN r * ln(0.3) ELSE 0 END + CASE WHEN n > r THEN (n - r) * ln(0.7) ELSE 0 END AS log_score
FROM (SELECT s_suppkey, (20 + s_suppkey)::DOUBLE AS n, (s_suppkey % 20)::DOUBLE AS r FROM supplier)""")
def c40(spark, d):
    n, r = (F.col("s_suppkey") + 20).cast("double"), (F.col("s_suppkey") % 20).cast("double")
    return load(spark, d, "supplier").select("s_suppkey", stats.binomial_log_pmf(r, n, F.lit(0.3)).alias("log_score"))


@query("c41_hr_log_score", """
SELECT s_suppkey, -0.5 * (ln(2 * pi() * v) + power(ln(hr), 2) / v) AS log_score FROM (SELECT s_suppkey, hr, 1 + power((ln(hr * 1.5) - ln(hr / 1.5)) / (2 * 1.959964), 2) AS v FROM (SELECT s_suppkey, 0.4 + (s_suppkey % 10) / 10.0 AS hr FROM supplier))""")
def c41(spark, d):
    hr = 0.4 + (F.col("s_suppkey") % 10) / 10.0
    return load(spark, d, "supplier").select("s_suppkey", stats.hr_log_score(hr, hr / 1.5, hr * 1.5, F.lit(0.0), F.lit(1.0)).alias("log_score"))


@query("c42_trial_size", """
WITH g AS (SELECT s, h FROM (VALUES (0.27::DOUBLE), (0.58), (0.73)) a(s), (VALUES (0.4::DOUBLE), (0.5), (0.6)) b(h)), m AS (SELECT s, h, 1 - power(1 - s, h) AS loss, 4 * power(1.959964 + 0.841621, 2) / power(ln(h), 2) AS ev FROM g)
SELECT s AS stop_loss, h AS hazard_ratio, loss AS maintain_loss, ceil(ev)::BIGINT AS events, ceil(ev / ((s + loss) / 2) / 0.85)::BIGINT AS patients, ceil(ev / ((s + loss) / 2) / 0.85 / 2)::BIGINT AS per_arm FROM m""")
def c42(spark, d):
    grid = spark.createDataFrame([(s, h) for s in (0.27, 0.58, 0.73) for h in (0.4, 0.5, 0.6)], "stop_loss double, hazard_ratio double")
    return grid.withColumn("x", stats.trial_size(F.col("stop_loss"), F.col("hazard_ratio"))).select("stop_loss", "hazard_ratio", "x.*")


@query("c43_regimen_cost", """
SELECT p_brand, count(*) AS n, sum(p_retailprice * 52 / 4) AS yearly, sum(p_retailprice * 52 / 4 * (1 - 0.15)) AS after_dropout, min(p_retailprice / p_size) AS least_per_unit FROM part GROUP BY 1""")
def c43(spark, d):
    yearly = F.col("p_retailprice") * 52 / 4
    return load(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(yearly).alias("yearly"), F.sum(yearly * 0.85).alias("after_dropout"), F.min(F.col("p_retailprice") / F.col("p_size")).alias("least_per_unit"))


@query("c44_registry_normalisers", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RECRUITING' ELSE 'NOT_YET_OPEN' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'INTERVENTIONAL' WHEN 1 THEN 'OBSERVATIONAL' ELSE 'EXPANDED ACCESS' END AS study_type,
 CASE o_orderkey % 4 WHEN 0 THEN ['PHASE2', 'PHASE3'] WHEN 1 THEN ['PHASE4'] WHEN 2 THEN []::VARCHAR[] ELSE ['POST_MARKETING'] END AS phases, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def c44(spark, d):
    o = load(spark, d, "orders")
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN ' Closed' WHEN 'O' THEN 'open' ELSE 'not yet, open' END")
    kind = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Intervention trial' WHEN 1 THEN 'observational study' ELSE 'Expanded access' END")
    phase = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Phase 2/3' WHEN 1 THEN '4' WHEN 2 THEN 'N/A' ELSE 'post marketing' END")
    day = F.expr("CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 1 THEN date_format(o_orderdate, 'dd-MM-yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END")
    return o.select("o_orderkey", text.registry_status(status, {"closed": "COMPLETED", "open": "RECRUITING"}).alias("status"), text.study_type(kind).alias("study_type"), text.bare_phases(phase).alias("phases"), text.iso_date(day).alias("day"))


@query("c45_outcome_family", """
SELECT l_returnflag, l_linestatus, count(*) AS n, min(CASE WHEN l_linestatus = 'F' THEN 'Adverse events' WHEN l_returnflag = 'R' THEN 'Repigmentation' WHEN l_returnflag = 'A' THEN 'Quality of life' ELSE 'Other outcomes' END) AS family FROM lineitem GROUP BY 1, 2""")
def c45(spark, d):
    named = F.expr("CASE l_returnflag WHEN 'R' THEN 'F-VASI75' WHEN 'A' THEN 'DLQI change' ELSE 'weight' END")
    family = F.when(F.col("l_linestatus") == "F", F.lit("Adverse events")).otherwise(F.coalesce(text.first_of({"Repigmentation": named.rlike("(?i)vasi|repigment"), "Quality of life": named.rlike("(?i)dlqi|qol")}), F.lit("Other outcomes")))
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min(family).alias("family"))


@query("c46_label_prefix", "SELECT doc_id, trim(text) AS value FROM documents")
def c46(spark, d):
    raw = F.concat(F.expr("CASE doc_id % 3 WHEN 0 THEN 'Inclusion criteria: ' WHEN 1 THEN 'Condition 2: CONDITION: ' ELSE '' END"), F.col("text"))
    return load(spark, d, "documents").select("doc_id", text.strip_label(raw).alias("value"))
