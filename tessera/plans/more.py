"""Queries over sources on pages, sinks, enrichment, prediction and discovery (inventory S, K, C, G, M, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import stats, text
from tessera.operators import discovery, enrichment, ingestion, joins, links, ranking
from tessera.plans.registry import load, query
from tessera.sources import html, sinks


@query("s25_page_text", r"""
SELECT page_id, len(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
 '(?i)</(p|div|li|tr|h[1-6])\s*>|<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'))) AS chars FROM pages""")
def s25(spark, d):
    return load(spark, d, "pages").select("page_id", F.length(html.page_text(F.col("html"))).cast("long").alias("chars"))


@query("s26_data_tables")
def s26(spark, d):
    return load(spark, d, "pages").select("page_id", F.size(html.data_tables("html")).alias("tables"))


@query("s27_payload_manifest", "SELECT source, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes, min(sha256(text)) AS first_sha FROM documents GROUP BY 1")
def s27(spark, d):
    m = load(spark, d, "documents").select("source", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha"))
    return m.groupBy("source").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.min("sha").alias("first_sha"))


@query("k01_upsert", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name FROM customer UNION ALL SELECT 1000000 + s_suppkey, 'new' FROM supplier""")
def k01(spark, d):
    old = load(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("name")).union(load(spark, d, "supplier").select(F.col("s_suppkey") + 1000000, F.lit("new")))
    return sinks.merged(old, new, ["c_custkey"])


@query("k01_stale_embeddings", "SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0")
def k01b(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"))
    return sinks.stale_embeddings(e, e.where("document_id % 4 = 0")).select(F.col("document_id").alias("vec_id"))


@query("c07_affiliation_countries", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN ['Spain'] WHEN n_nationkey % 3 = 1 THEN ['Pakistan'] ELSE []::VARCHAR[] END AS countries FROM nation")
def c07(spark, d):
    a = F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'Dept, Lahore Road, Spain' WHEN 1 THEN 'University, Lahore' ELSE 'Institute' END")
    return load(spark, d, "nation").select("n_nationkey", enrichment.affiliation_countries(a, {"Spain": "(?i)\\bspain\\b", "France": "(?i)\\bfrance\\b"}, {"(?i)\\blahore\\b": "Pakistan"}).alias("countries"))


@query("c30_directional_verbs", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'activates' WHEN 1 THEN 'inhibits' END AS predicate FROM supplier")
def c30(spark, d):
    s = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'JAK1 activates STAT1' WHEN 1 THEN 'JAK1 strongly suppressed STAT1' WHEN 2 THEN 'JAK1 was inhibited by STAT1' ELSE 'JAK1. It blocks STAT1' END")
    return load(spark, d, "supplier").select("s_suppkey", enrichment.stated_direction(F.lit("JAK1"), F.lit("STAT1"), s).alias("x")).select("s_suppkey", "x.predicate")


@query("j19_blind_pairs", """
WITH u AS (SELECT l_orderkey AS s, l_linenumber AS n, min(l_partkey) % 5 AS x FROM lineitem GROUP BY 1, 2), a AS (SELECT s, n AS a, x FROM u WHERE n <= 2), b AS (SELECT s, n AS b, x FROM u WHERE n = 3) SELECT s AS source_id, min(a) AS a, 3 AS b FROM a JOIN b USING (s, x) GROUP BY s""")
def j19(spark, d):
    l = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 5).alias("x"))
    side = lambda c: l.where(c).select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("id"), F.array("x").alias("numbers"))
    return enrichment.paired_extractions(side("l_linenumber <= 2"), side("l_linenumber = 3")).select("source_id", "a", "b")


@query("j21_group_agents", "SELECT l_orderkey, l_linenumber, [min(l_returnflag)] AS agents FROM lineitem GROUP BY 1, 2")
def j21(spark, d):
    l = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    sid = F.col("l_orderkey").cast("string").alias("source_id")
    groups = l.select(sid, "l_orderkey", "l_linenumber", F.concat(F.lit("Arm #"), "l_linenumber").alias("title"))
    arms = l.select(sid, F.concat(F.lit("arm "), "l_linenumber").alias("label"), F.array(F.col("l_returnflag")).alias("interventions"))
    names = l.select(sid, F.col("l_returnflag").alias("name"), F.col("l_returnflag").alias("agent")).distinct()
    return enrichment.group_agents(groups, arms, names).select("l_orderkey", "l_linenumber", "agents")


@query("w15_surest_passage", "SELECT l_suppkey, l_partkey, arg_max(l_orderkey, struct_pack(d := l_discount, o := -l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1, 2")
def w15(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max_by("l_orderkey", F.struct("l_discount", -F.col("l_orderkey"))).alias("l_orderkey"))


@query("g05_stale_claims", "SELECT o_custkey AS subject, list(o_orderkey ORDER BY o_orderkey) AS evidence FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1")
def g05(spark, d):
    o = load(spark, d, "orders")
    edges = o.groupBy(F.col("o_custkey").alias("subject")).agg(F.array_sort(F.collect_list(F.col("o_orderkey"))).alias("k"))
    edges = edges.select("subject", F.transform("k", lambda k: F.concat(F.lit("ctgov:"), k)).alias("evidence"))
    held = o.where("o_orderkey % 3 > 0").select(F.lit("ctgov").alias("source"), F.col("o_orderkey").cast("string").alias("source_id"))
    out = enrichment.stale_claims(edges, held)
    return out.select("subject", F.transform("evidence", lambda e: F.substring(e, 7, 20).cast("long")).alias("evidence"))


@query("g07_outcome_edges", "SELECT l_partkey % 50 AS subject, l_returnflag AS object, max(l_quantity) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2")
def g07(spark, d):
    arms = load(spark, d, "lineitem").select(F.expr("CASE l_linestatus WHEN 'F' THEN 'active' ELSE 'placebo' END").alias("arm_role"), (F.col("l_partkey") % 50).alias("agent"), F.col("l_returnflag").alias("endpoint"), F.col("l_quantity").cast("string").alias("source_id"), F.col("l_discount").alias("percent"), F.col("l_quantity").alias("n_analyzed"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    e = enrichment.outcome_edges(arms, "d")
    return e.select("subject", F.substring("object", 4, 1).alias("object"), F.col("evidence").cast("double").alias("n"))


@query("g10_paper_edges", "SELECT s_suppkey, 'a + b' AS subject, CASE WHEN s_suppkey % 2 = 0 THEN 'placebo' END AS comparator FROM supplier WHERE s_suppkey % 5 > 0")
def g10(spark, d):
    v = load(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ref"), F.expr("CASE s_suppkey % 2 WHEN 0 THEN 'B plus A vs. Placebo' ELSE 'A and B' END").alias("arm_label"), F.lit("F75").alias("outcome"), (F.col("s_suppkey") % 5 == 0).alias("pooled"))
    return enrichment.paper_edges(v, "d").select(F.col("evidence").cast("long").alias("s_suppkey"), "subject", "comparator")


@query("g11_posted_edges", """
WITH u AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, min(l_quantity)::INTEGER AS v FROM lineitem GROUP BY 1, 2), c AS (SELECT l_orderkey, arg_min(v, l_linenumber) AS cv FROM u WHERE f = 'N' GROUP BY 1) SELECT l_orderkey, l_linenumber, v AS value, cv AS control_value FROM u LEFT JOIN c USING (l_orderkey) WHERE f = 'R'""")
def g11(spark, d):
    l = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_quantity").cast("int").alias("v"))
    m = l.select(F.col("l_orderkey").alias("source_id"), F.lit(0).alias("measure_no"), F.lit("all").alias("class_title"), F.col("l_linenumber").alias("group_id"), F.lit("o").alias("title"), F.col("v").alias("value"))
    g = l.select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("group_id"), F.expr("CASE f WHEN 'N' THEN 'placebo' WHEN 'R' THEN 'active' ELSE 'other' END").alias("role"), F.col("l_linenumber").alias("agent"))
    return enrichment.posted_edges(m, g).select(F.col("source_id").alias("l_orderkey"), F.col("subject").alias("l_linenumber"), "value", "control_value")


@query("g13_literature_drops", "SELECT CASE WHEN l_discount < 0.03 THEN 'low score' WHEN l_partkey % 7 = 0 OR l_suppkey % 7 = 0 THEN 'unknown concept' WHEN l_partkey % 20 = l_suppkey % 20 THEN 'same node' END AS reason, count(*) AS n FROM lineitem WHERE l_discount < 0.03 OR l_partkey % 7 = 0 OR l_suppkey % 7 = 0 OR l_partkey % 20 = l_suppkey % 20 GROUP BY 1")
def g13(spark, d):
    l = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.col("l_partkey").alias("first"), F.col("l_suppkey").alias("second"), F.lit("Association").alias("type"), F.col("l_discount").alias("score"))
    ids = l.select(F.explode(F.array("first", "second")).alias("identifier")).distinct().where("identifier % 7 > 0")
    return enrichment.literature_edges(l, ids.select("identifier", (F.col("identifier") % 20).alias("node"), F.lit("drug").alias("kind")), 0.03)[1]


@query("g14_specific_genes", """
WITH m AS (SELECT l_partkey % 50 AS gene, l_suppkey % 8 AS grp, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), z AS (SELECT gene, grp, (v - avg(v) OVER (PARTITION BY gene)) / stddev_samp(v) OVER (PARTITION BY gene) AS z FROM m) SELECT * FROM z WHERE z >= 1.5""")
def g14(spark, d):
    m = load(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("gene"), (F.col("l_suppkey") % 8).alias("grp")).agg(F.avg("l_quantity").alias("v"))
    return enrichment.specific(m, "gene", "grp", "v", 1.5).select("gene", "grp", "z")


@query("g21_pair_synergy", """
WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem), n AS (SELECT s, count(*) AS n FROM p GROUP BY 1), v AS (SELECT l_suppkey AS s, avg(l_discount) AS v FROM lineitem GROUP BY 1), c AS (SELECT a.s AS a, b.s AS b, count(*) AS c FROM p a JOIN p b ON a.t = b.t AND a.s < b.s GROUP BY 1, 2)
SELECT a, b, va.v + vb.v - 0.1 * c / (na.n + nb.n - c) AS synergy FROM c JOIN n na ON na.s = a JOIN n nb ON nb.s = b JOIN v va ON va.s = a JOIN v vb ON vb.s = b""")
def g21(spark, d):
    l = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("drug"), F.col("l_partkey").alias("target"), F.col("l_discount").alias("score"))
    return enrichment.pair_synergy(l.select("drug", "target"), l.groupBy("drug").agg(F.avg("score").alias("score"))).select("a", "b", "synergy")


@query("t10_link_topk", """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT (SELECT v FROM e WHERE vec_id = 0) AS h, (SELECT v FROM e WHERE vec_id = 1) AS r), s AS (SELECT vec_id AS node, label % 2 AS kind, list_dot_product(list_transform(list_zip(h, r), lambda x: x[1] * x[2]), v) AS score FROM e, f)
(SELECT 'forward' AS direction, row_number() OVER (ORDER BY score DESC, node) AS rank, node, score, 1 / (1 + exp(-score)) AS probability FROM s WHERE kind = 0 AND node <> 0 ORDER BY rank LIMIT 10)
UNION ALL (SELECT 'reverse', row_number() OVER (ORDER BY score DESC, node), node, score, 1 / (1 + exp(-score)) FROM s WHERE node <> 0 ORDER BY 2 LIMIT 15) UNION ALL SELECT 'triple', 1, node, score, 1 / (1 + exp(-score)) FROM s WHERE node = 5""")
def t10(spark, d):
    e = load(spark, d, "embeddings")
    fixed = {r.vec_id: F.array(*[F.lit(float(x)) for x in r.embedding]) for r in e.where("vec_id IN (0, 1)").collect()}  # two vectors
    nodes = e.select(F.col("vec_id").alias("node"), (F.col("label") % 2).alias("kind"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = links.distmult_query(fixed[0], fixed[1])
    modes = {"forward": links.top_links(nodes, asked, 10, kind=0, but=(0,)), "reverse": links.top_links(nodes, asked, 15, but=(0,)), "triple": links.top_links(nodes.where("node = 5"), asked, 1)}
    parts = [df.select(F.lit(name).alias("direction"), "rank", "node", "score", "probability") for name, df in modes.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("m01_exclusion_reasons", """
SELECT CASE WHEN l_linenumber = 7 THEN 'treatment switch or extension study' WHEN l_returnflag = 'A' THEN 'arm role' WHEN l_quantity < 0.8 * peak THEN 'arm no longer reports the group it enrolled' WHEN l_linenumber > 4 THEN 'beyond the last week' ELSE 'selected' END AS reason, count(*) AS n FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_suppkey, l_partkey) AS peak FROM lineitem) GROUP BY 1""")
def m01(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_id"), F.col("l_partkey").cast("string").alias("arm_label"), F.lit("e").alias("endpoint"), F.lit("F").alias("instrument"), F.lit(75).alias("threshold"), F.lit(None).cast("string").alias("assessor"), F.expr("CASE l_returnflag WHEN 'R' THEN 'active' WHEN 'N' THEN 'placebo' ELSE 'other' END").alias("arm_role"), F.lit("x").alias("agent"), F.lit(1.0).alias("dose_value"), F.col("l_quantity").alias("n_analyzed"), F.lit(1).alias("responders"), F.col("l_linenumber").alias("week"), F.lit(None).cast("string").alias("population"), F.lit("PRIMARY").alias("outcome_type"), F.expr("CASE l_linenumber WHEN 7 THEN array('switch') ELSE array('none') END").alias("flags"))
    caps, held = spark.createDataFrame([], "source_id string, cap int"), spark.createDataFrame([], "source_id string, active boolean")
    return discovery.exclusion_reasons(rows, "F", 4, caps, held, ("switch",)).groupBy(F.coalesce("reason", F.lit("selected")).alias("reason")).agg(F.count("*").alias("n"))


@query("m03_predicted_intervals", "SELECT event_type, count(*) AS draws, avg(value / 200) AS mean, quantile_cont(value / 200, 0.5) AS median, quantile_cont(value / 200, 0.975) AS hi95 FROM events GROUP BY 1")
def m03(spark, d):
    draws = load(spark, d, "events").select("event_type", (F.col("value") / 200).alias("p_active"), F.lit(0.1).alias("p_control"))
    p = discovery.predicted(draws.select("event_type").distinct(), draws, ["event_type"])
    return p.select("event_type", "draws", "p_active.mean", "p_active.median", "p_active.hi95")


@query("m04_extrapolation_notes", "SELECT s_suppkey, list_filter([CASE WHEN s_nationkey >= 20 THEN 'agent not in the data' END, CASE WHEN s_nationkey < 20 AND s_suppkey % 10 > 5 THEN 'dose above the largest studied' END, CASE WHEN s_nationkey < 20 AND s_suppkey % 7 > 3 THEN 'week after the last observed' END], lambda x: x IS NOT NULL) AS notes FROM supplier")
def m04(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("agent"), (F.col("s_suppkey") % 10).alias("dose"), (F.col("s_suppkey") % 7).alias("week"), F.lit("oral").alias("route"))
    seen = load(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("agent"), F.lit(5).alias("max_dose"), F.lit(3).alias("max_week"), F.array(F.lit("oral")).alias("routes"))
    return discovery.extrapolation_notes(s, seen).select("s_suppkey", "notes")


@query("m05_leave_one_out", """
WITH t AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q, avg(l_quantity) AS observed FROM lineitem GROUP BY 1), a AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM t) SELECT l_suppkey, observed, (a.s - t.s) / (a.n - t.n) AS mean FROM t, a""")
def m05(spark, d):
    return discovery.leave_one_out(load(spark, d, "lineitem").select("l_suppkey", "l_quantity"), "l_suppkey", "l_quantity").select("l_suppkey", "observed", "mean")


@query("m14_forecast_scores", """
WITH p AS (SELECT s_suppkey AS key, lgamma(11) - lgamma(r + 1) - lgamma(11 - r) AS c, r FROM (SELECT s_suppkey, (s_suppkey % 10)::DOUBLE AS r FROM supplier)) SELECT key, ln((exp(c + r * ln(0.3) + (10 - r) * ln(0.7)) + exp(c + r * ln(0.6) + (10 - r) * ln(0.4))) / 2) + lgamma(11) - lgamma(4) - lgamma(8) + 3 * ln(0.2) + 7 * ln(0.8) AS log_score FROM p""")
def m14(spark, d):
    s = load(spark, d, "supplier")
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    forecasts = s.select(F.col("s_suppkey").alias("key"), F.lit("m").alias("model"), lit(0.3, 0.6).alias("p_active"), lit(0.2, 0.2).alias("p_control"))
    outcomes = s.select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 10).alias("r_active"), F.lit(10).alias("n_active"), F.lit(3).alias("r_control"), F.lit(10).alias("n_control"))
    return discovery.scored_forecasts(forecasts, outcomes).select("key", "log_score")


@query("m19_dry_run", "SELECT 'lang' AS column, count(*) FILTER (WHERE lang = 'en') AS changes FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE source LIKE 'src1%') FROM documents")
def m19(spark, d):
    docs = load(spark, d, "documents").select("lang", "source")
    repairs = {"lang": F.when(F.col("lang") == "en", "eng").otherwise(F.col("lang")), "source": F.regexp_replace("source", "^src1", "SRC1")}
    return discovery.repaired(docs, repairs)[1]


@query("a39_model_information")
def a39(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("model")).agg(F.avg(F.col("l_quantity") / 60).alias("p"), F.lit(30).alias("n"))
    return discovery.mutual_information(rows, ["l_suppkey"], 100)


@query("x02_adverse_event_groups", "SELECT o_orderkey::VARCHAR AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 100)::INTEGER END AS n FROM orders")
def x02(spark, d):
    g = F.struct(F.lit("g").alias("id"), F.lit("t").alias("title"), F.expr("CASE o_orderkey % 2 WHEN 0 THEN string(o_orderkey % 100) ELSE 'n/a' END").alias("seriousNumAffected"), F.lit("1").alias("seriousNumAtRisk"), F.lit(None).cast("string").alias("otherNumAffected"))
    t = load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("source_id"), F.array(g).alias("event_groups"))
    return ingestion.adverse_event_groups(t).select("source_id", F.col("seriousNumAffected").alias("n"))


@query("x07_three_keys", """
WITH i AS (SELECT o_orderkey AS o, o_custkey % 400 AS doi, o_orderkey % 900 AS title FROM orders), f AS (SELECT * FROM i WHERE doi > 100 AND title > 200), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY o) AS n FROM f) WHERE n = 1) SELECT o FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY o) AS m FROM a) WHERE m = 1""")
def x07(spark, d):
    i = load(spark, d, "orders").select(F.col("o_orderkey").alias("o"), (F.col("o_custkey") % 400).alias("doi"), (F.col("o_orderkey") % 900).alias("title"))
    held = {"doi": spark.range(101).select(F.col("id").alias("doi")), "title": spark.range(201).select(F.col("id").alias("title"))}
    return ingestion.not_held(i, held, "o").select("o")


@query("x08_fill_in", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000) AND page_id % 3 = 0")
def x08(spark, d):
    body = load(spark, d, "documents").where("n_chars > 1000").select(F.col("doc_id").alias("page_id"))
    open_access = load(spark, d, "pages").where("page_id % 3 = 0").select("page_id")
    return joins.pending(open_access, body, ["page_id"])


@query("x11_trial_names", "SELECT DISTINCT source_id, name FROM (SELECT l_orderkey::VARCHAR AS source_id, l_returnflag AS name, l_linestatus FROM lineitem) WHERE l_linestatus = 'F'")
def x11(spark, d):
    i = F.struct(F.expr("CASE l_linestatus WHEN 'F' THEN 'Drug' ELSE 'Device' END").alias("type"), F.col("l_returnflag").alias("name"), F.lit(None).cast("array<string>").alias("other_names"))
    t = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("source_id")).agg(F.collect_list(i).alias("interventions"))
    return enrichment.trial_names(t)


@query("x14_silver", "SELECT doc_id AS pmid, CASE WHEN toxic < 1 THEN 'none' ELSE 'rel' END AS type FROM labels WHERE toxic IS NOT NULL AND doc_id % 4 > 0")
def x14(spark, d):
    l = load(spark, d, "labels")
    rel = l.select(F.col("doc_id").alias("pmid"), F.lit("rel").alias("type"), F.col("toxic").cast("double").alias("score"))
    return enrichment.silver(rel, l.where("doc_id % 4 = 0").select(F.col("doc_id").alias("pmid")), 1.0).select("pmid", "type")


@query("x22_worklist", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 > 0 ORDER BY o_orderstatus = 'F' DESC, o_totalprice::INTEGER DESC, o_orderkey LIMIT 100")
def x22(spark, d):
    t = load(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), (F.col("o_orderstatus") == "F").alias("has_results"), F.rint("o_totalprice").cast("int").alias("enrollment_count"))
    return enrichment.worklist(t, t.where("source_id % 5 = 0")).limit(100).select(F.col("source_id").alias("o_orderkey"))


@query("x23_informativeness", "WITH t AS (SELECT l_suppkey, count(*) AS n, avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0 END) AS w FROM lineitem GROUP BY 1) SELECT avg(w) AS win_rate, avg(CASE WHEN n >= 600 THEN 1.0 ELSE 0 END) AS estimable FROM t")
def x23(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("trial"), F.col("l_quantity").alias("a"), F.lit(25.0).alias("b"))
    return discovery.informativeness(rows, 600)


@query("b01_bounds_by_source", "WITH g AS (SELECT source, count(*) AS grp, count(quality) AS n, coalesce(sum(quality), 0) AS r FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) SELECT source, 100.0 * r / grp AS floor FROM g WHERE n > 0")
def b01(spark, d):
    both = load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels"), "doc_id", "left")
    g = both.groupBy("source").agg(F.count("*").alias("grp"), F.count("quality").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("r"))
    return g.select("source", stats.bounds(F.col("r"), F.col("n"), F.col("grp"))["floor"].alias("floor")).where("floor IS NOT NULL")


@query("w02_first_of_best", "SELECT * EXCLUDE n FROM (SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def w02(spark, d):
    rows = load(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.best_per_key(rows, ["l_suppkey", "l_returnflag"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_extendedprice")


@query("c11_cited_ids", "SELECT s_suppkey, list_sort(['NCT' || (10000000 + s_suppkey), 'ISRCTN' || (20000000 + s_suppkey)]) AS ids FROM supplier")
def c11(spark, d):
    raw = F.concat(F.lit("nct-"), F.col("s_suppkey") + 10000000, F.lit("; protocol 12, ISRCTN "), F.lit("| ISRCTN"), F.col("s_suppkey") + 20000000, F.lit("; NCT"), F.col("s_suppkey") + 10000000)
    return load(spark, d, "supplier").select("s_suppkey", text.cited_ids(raw).alias("ids"))


@query("t11_pending_by_information", "SELECT s_suppkey AS key, s_acctbal AS information FROM supplier WHERE s_suppkey % 4 > 0 ORDER BY s_acctbal DESC, s_suppkey")
def t11(spark, d):
    s = load(spark, d, "supplier")
    return discovery.pending_by_information(s.select(F.col("s_suppkey").alias("key")), s.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("information")), s.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("key")))


@query("a11_weighted_relevance", r"""
WITH h AS (SELECT doc_id, t, CASE WHEN regexp_matches(lower(left(text, 60)), '(^|[^a-z0-9])' || t) THEN 1.0 ELSE 0.5 END::DOUBLE AS w FROM documents, (VALUES ('the'), ('que')) x(t) WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || t)), i AS (SELECT t, ln(((SELECT count(DISTINCT doc_id) FROM h) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM h GROUP BY t) SELECT doc_id, sum(idf * w) AS relevance FROM h JOIN i USING (t) GROUP BY doc_id""")
def a11(spark, d):
    from tessera.operators.search import at_word_start

    tokens = ("the", "que")
    docs = load(spark, d, "documents").select("doc_id", F.lower("text").alias("t"), F.lower(F.substring("text", 1, 60)).alias("title"))
    weights = [F.when(at_word_start(F.col("title"), x), 1.0).when(at_word_start(F.col("t"), x), 0.5).otherwise(0.0) for x in tokens]
    hits = docs.select("doc_id", F.array(*weights).alias("w")).where(F.exists("w", lambda x: x > 0))
    counts = hits.agg(F.struct(F.count("*").alias("n"), F.array(*[F.count_if(F.col("w")[i] > 0) for i in range(2)]).alias("df"))).scalar()
    s = hits.withColumn("s", counts)
    idf = lambda i: F.log((F.col("s.n") + 1.0) / (F.col("s.df")[i] + 1.0)) + 1
    return s.select("doc_id", (F.col("w")[0] * idf(0) + F.col("w")[1] * idf(1)).alias("relevance"))
