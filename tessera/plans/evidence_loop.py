"""Queries over lookups, evidence units, forecasts, readings and incremental steps (inventory J, A, G, V, M, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.passages import Marks, sections
from tessera.functions.text import sponsor_key
from tessera.operators import aggregates, discovery, embedding, enrichment, ingestion, joins, ranking
from tessera.plans.payloads import folder
from tessera.plans.registry import load, query
from tessera.sources import common, registries, sinks


@query("j13_outcome_rows", """
WITH f AS (SELECT s_suppkey AS key, s_suppkey AS trial, (s_suppkey % 7)::INTEGER AS dose FROM supplier), r AS (SELECT l_orderkey * 10 + l_linenumber AS row, l_suppkey AS source_id, l_partkey AS study_id, CASE WHEN l_returnflag = 'N' THEN 'placebo' ELSE 'active' END AS role, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS dose, l_quantity AS n FROM lineitem),
m AS (SELECT key, role, row, n FROM f JOIN r ON trial = source_id WHERE role = 'placebo' OR r.dose = f.dose UNION ALL SELECT key, role, row, n FROM f JOIN r ON trial = study_id WHERE role = 'placebo' OR r.dose = f.dose) SELECT key, role, row FROM (SELECT *, row_number() OVER (PARTITION BY key, role ORDER BY n DESC, row) AS k FROM m) WHERE k = 1""")
def j13(spark, d):
    s = load(spark, d, "supplier")
    f = s.select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").alias("trial"), (F.col("s_suppkey") % 7).cast("int").alias("dose"))
    l = load(spark, d, "lineitem")
    r = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("study_id"), F.when(F.col("l_returnflag") == "N", "placebo").otherwise("active").alias("role"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("dose"), F.col("l_quantity").alias("n"))
    return joins.outcome_rows(f, r, [F.desc("n"), F.col("row")]).select("key", "role", "row")


@query("j15_publications", """
WITH r AS (SELECT DISTINCT l_orderkey AS trial, l_partkey AS paper FROM lineitem WHERE l_linenumber % 2 = 1), c AS (SELECT DISTINCT l_orderkey AS trial, l_partkey AS paper FROM lineitem) SELECT trial, paper, CASE WHEN (trial, paper) IN (SELECT (trial, paper) FROM r) THEN 'reference' ELSE 'citing' END AS kind FROM c""")
def j15(spark, d):
    l = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("trial"), F.col("l_partkey").alias("paper"), "l_linenumber")
    return joins.publications(l.where("l_linenumber % 2 = 1"), l)


@query("j17_node_index", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey WHEN c_nationkey % 3 = 1 THEN c_nationkey END AS index FROM customer")
def j17(spark, d):
    nodes = load(spark, d, "nation").select(F.col("n_nationkey").alias("index"), F.concat(F.lit("sym"), "n_nationkey").alias("symbol"), F.array(F.concat(F.lit("Old"), "n_nationkey")).alias("aliases"))
    names = load(spark, d, "customer").select("c_custkey", F.expr("concat(CASE c_nationkey % 3 WHEN 0 THEN ' SYM' WHEN 1 THEN 'old' ELSE 'other' END, c_nationkey)").alias("name"))
    return joins.node_index(names, nodes).select("c_custkey", "index")


@query("j22_first_found", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'p' || o_custkey WHEN 1 THEN 'x' || o_custkey END AS title FROM orders")
def j22(spark, d):
    o = load(spark, d, "orders")
    left = o.select("o_orderkey", F.concat(F.lit("p"), "o_custkey", F.expr("CASE o_orderkey % 3 WHEN 0 THEN '' ELSE '?' END")).alias("pmid"), F.concat(F.lit("d"), "o_custkey", F.expr("CASE o_orderkey % 3 WHEN 2 THEN '?' ELSE '' END")).alias("doi"))
    c = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    held = c.select(F.lit("pubmed").alias("kind"), F.concat(F.lit("p"), "k").alias("id"), F.concat(F.lit("p"), "k").alias("title")).union(c.select(F.lit("crossref"), F.concat(F.lit("d"), "k"), F.concat(F.lit("x"), "k")))
    return joins.first_found(left, held, [("pubmed", "pmid"), ("crossref", "doi")], "title").select("o_orderkey", "title")


_ARMS = "SELECT l_suppkey AS trial, l_returnflag AS endpoint, l_linenumber AS week, CASE WHEN l_linestatus = 'F' AND l_quantity < 10 THEN 'placebo' ELSE 'active' END AS role, l_partkey % 5 AS agent, 'r' || (l_partkey % 9) AS regimen FROM lineitem"


def _arms(spark, d):
    l = load(spark, d, "lineitem")
    return l.select(F.col("l_suppkey").alias("trial"), F.col("l_returnflag").alias("endpoint"), F.col("l_linenumber").alias("week"), F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 10), "placebo").otherwise("active").alias("role"), (F.col("l_partkey") % 5).alias("agent"), F.concat(F.lit("r"), (F.col("l_partkey") % 9).cast("string")).alias("regimen"))


@query("m10_control_units", f"WITH a AS ({_ARMS}) SELECT DISTINCT a.agent, 'control|' || trial || '|' || endpoint || '|' || week || '|' || regimen AS unit_key FROM a WHERE role = 'active' AND EXISTS (SELECT 1 FROM a b WHERE b.role = 'placebo' AND b.trial = a.trial AND b.endpoint = a.endpoint AND b.week = a.week)")
def m10(spark, d):
    return discovery.control_units(_arms(spark, d)).select("agent", "unit_key")


@query("m10_pair_units", f"WITH a AS (SELECT DISTINCT trial, endpoint, week, agent, regimen FROM ({_ARMS}) WHERE role = 'active'), o AS (SELECT trial, endpoint, week, agent AS a2, regimen AS other FROM a) SELECT agent, 'pair|' || trial || '|' || endpoint || '|' || week || '|' || regimen || '|' || other AS unit_key FROM a JOIN o USING (trial, endpoint, week) WHERE regimen < other")
def m10b(spark, d):
    return discovery.pair_units(_arms(spark, d)).select("agent", "unit_key")


@query("m03_pair_draws", """
WITH x AS (SELECT event_type AS scenario, user_id AS draw, avg(value) / 200 AS p FROM events GROUP BY 1, 2), b AS (SELECT a.p - b.p AS d FROM x a JOIN x b ON a.draw = b.draw AND a.scenario = 'click' AND b.scenario = 'view') SELECT 'click' AS a, 'view' AS b, count(*) AS draws, avg(d) AS mean, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.9) AS hi80, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0 END) AS p_better FROM b""")
def m03(spark, d):
    draws = load(spark, d, "events").groupBy(F.col("event_type").alias("scenario"), F.col("user_id").alias("draw")).agg((F.avg("value") / 200).alias("p"))
    pairs = spark.createDataFrame([("click", "view")], "a string, b string")
    return discovery.predicted_pairs(pairs, draws).select("a", "b", "draws", "mean", "median", "hi80", "p_better")


@query("m05_time_backtest", """
WITH r AS (SELECT l_suppkey AS series, l_linenumber * 4 AS week, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2), f AS (SELECT series, regr_slope(value, ln(week)) AS s, regr_intercept(value, ln(week)) AS i FROM r WHERE week <= 16 GROUP BY 1 HAVING count(*) >= 2)
SELECT series, week, value AS observed, i + s * ln(week) AS predicted, abs(value - (i + s * ln(week))) AS error FROM r JOIN f USING (series) WHERE week > 16""")
def m05(spark, d):
    rows = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("series"), (F.col("l_linenumber") * 4).alias("week")).agg(F.avg("l_quantity").alias("value"))
    return discovery.time_backtest(rows, ["series"], 16)


@query("a41_surprise", """
WITH s AS (SELECT event_type AS key, user_id % 9 AS value, count(*) AS n FROM events GROUP BY 1, 2), o AS (SELECT key, n AS own FROM s WHERE value = 3) SELECT key, sum(CASE WHEN n <= own THEN n ELSE 0 END) / sum(n)::DOUBLE AS surprise FROM s JOIN o USING (key) GROUP BY 1""")
def a41(spark, d):
    simulated = load(spark, d, "events").select(F.col("event_type").alias("key"), (F.col("user_id") % 9).alias("value"))
    return discovery.surprises(simulated.select("key", F.lit(3).cast("long").alias("value")).distinct(), simulated)


@query("g09_mechanism_nodes", "SELECT DISTINCT kind, name FROM (SELECT 'mechanism' AS kind, p_name AS name FROM part UNION ALL SELECT 'cell_type', p_type FROM part UNION ALL SELECT 'pathway', p_brand FROM part UNION ALL SELECT 'pathway', 'P' || p_size FROM part)")
def g09(spark, d):
    p = load(spark, d, "part").select(F.col("p_name").alias("title"), F.col("p_type").alias("cell_type"), F.lit(" ").alias("phenotype"), F.array("p_brand").alias("upstream"), F.array(F.concat(F.lit("P"), "p_size")).alias("downstream"))
    return enrichment.mechanism_nodes(p)


@query("g09_mechanism_edges", "SELECT p_brand AS subject, 'causes' AS predicate, p_name AS object, CASE WHEN p_size % 2 = 0 THEN 'observed' ELSE 'asserted' END AS claim, CASE WHEN p_size % 2 = 0 THEN 'perturbation_in_animal' END AS causal_level, CASE WHEN p_size % 2 = 0 THEN 'b' END AS evidence FROM part UNION ALL SELECT p_name, 'causes', 'P' || p_size, CASE WHEN p_size % 2 = 0 THEN 'observed' ELSE 'asserted' END, CASE WHEN p_size % 2 = 0 THEN 'perturbation_in_animal' END, CASE WHEN p_size % 2 = 0 THEN 'b' END FROM part")
def g09b(spark, d):
    e = lambda ref, stance, level: F.struct(F.lit(ref).alias("ref"), F.lit(stance).alias("stance"), F.lit(level).alias("causal_level"))
    stance = F.when(F.col("p_size") % 2 == 0, "supports").otherwise("neutral")
    own = F.array(e("a", "contradicts", "perturbation_in_human"), F.struct(F.lit("b").alias("ref"), stance.alias("stance"), F.lit("association").alias("causal_level")), F.struct(F.lit("c").alias("ref"), stance.alias("stance"), F.lit("perturbation_in_animal").alias("causal_level")))
    p = load(spark, d, "part").select(F.col("p_name").alias("title"), F.array("p_brand").alias("upstream"), F.array(F.concat(F.lit("P"), "p_size")).alias("downstream"), own.alias("evidence"))
    return enrichment.mechanism_edges(p)


@query("g12_vocabulary_reading", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN ['B', 'A'] WHEN 1 THEN ['AB'] ELSE ['A'] END AS concepts FROM supplier WHERE s_suppkey % 5 < 3")
def g12(spark, d):
    text = F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'Beta + alpha one!' WHEN 1 THEN 'alpha one beta 1.5%' WHEN 2 THEN 'the Alpha One 20 mg cream' WHEN 3 THEN 'alpha one or beta' ELSE 'alpha one in a long line of words' END")
    vocabulary = spark.createDataFrame([("Alpha One", "A"), ("beta", "B"), ("alpha one  beta", "AB"), ("one", "C")], "name string, concept string")
    return enrichment.vocabulary_reading(load(spark, d, "supplier").select("s_suppkey", text.alias("t")), vocabulary, "s_suppkey", "t", ignored=("mg", "cream"))


@query("g16_directed_relations", "SELECT 'K' || s_suppkey AS subject, CASE WHEN s_suppkey % 3 = 0 THEN 'inhibits' ELSE 'activates' END AS predicate, 'T' || s_nationkey AS object FROM supplier WHERE s_suppkey % 3 < 2")
def g16(spark, d):
    s = load(spark, d, "supplier").select(F.concat(F.lit("T"), "s_nationkey").alias("first"), F.concat(F.lit("K"), "s_suppkey").alias("second"), "s_suppkey")
    said = F.concat(F.lit("We saw that "), "second", F.expr("CASE s_suppkey % 3 WHEN 0 THEN ' strongly suppresses ' WHEN 1 THEN ' induced ' ELSE ' binds ' END"), "first", F.lit(" in skin."))
    return enrichment.directed(s.withColumn("snippet", said)).select("subject", "predicate", "object")


@query("m13_registry_targets", "SELECT DISTINCT 'NCT' || s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 75 ELSE 50 END::INTEGER AS threshold, 24 AS week, 'a' || s_nationkey AS agent FROM supplier")
def m13(spark, d):
    s = load(spark, d, "supplier").select(F.concat(F.lit("NCT"), "s_suppkey").alias("source_id"), "s_suppkey", "s_nationkey")
    measure = F.expr("concat('Percentage achieving F-VASI', CASE s_suppkey % 2 WHEN 0 THEN '75' ELSE '50' END)")
    outcomes = F.array(F.struct(measure.alias("measure"), F.lit("Week 24").alias("time_frame")), F.struct(F.lit("Adverse events").alias("measure"), F.lit("Week 52").alias("time_frame")))
    found = discovery.registry_targets(s.select("source_id", outcomes.alias("outcomes")), s.select("source_id", F.concat(F.lit("a"), "s_nationkey").alias("agent"), F.lit(1.5).alias("dose_value")))
    return found.select("source_id", "threshold", "week", "agent")


@query("m18_checked_values", "SELECT s_suppkey AS id, unnest(CASE s_suppkey % 5 WHEN 0 THEN ['the source is not held'] WHEN 1 THEN ['the value is not printed', 'count and percentage disagree'] WHEN 2 THEN ['count and percentage disagree'] ELSE [] END) AS problem FROM supplier")
def m18(spark, d):
    k = F.col("s_suppkey")
    s = load(spark, d, "supplier")
    values = s.select(k.alias("id"), k.cast("string").alias("source_id"), F.lit(200).alias("n"), F.when(k % 5 == 2, 60).otherwise(51).alias("responders"), F.when(k % 5 == 1, 99.5).otherwise(25.5).alias("percent"))
    texts = s.where(k % 5 != 0).select(k.cast("string").alias("source_id"), F.concat(F.lit("Of 200 patients, 51 (25.5%) responded in arm "), k.cast("string")).alias("text"))
    return enrichment.checked_values(values, texts)


@query("v01_sections", "SELECT doc_id, ['', 'Aims', 'Results'] AS names, len(text) + 1 AS chars FROM documents")
def v01(spark, d):
    """Whole texts under two headings: the names of their sections and the length of the part before the first."""
    rows = load(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n## Aims\nx\n## Results\ny")).alias("text"))

    def run(frames):
        for pdf in frames:
            found = [list(sections(t)) for t in pdf["text"]]
            yield pdf.assign(names=[[s.section or "" for s in f] for f in found], chars=[f[0].end for f in found])[["doc_id", "names", "chars"]]

    return rows.mapInPandas(run, "doc_id long, names array<string>, chars long")


@query("v02_paragraphs", "SELECT doc_id, 1 + len(regexp_extract_all(text, '\\n\\s*\\n')) AS paragraphs FROM documents")
def v02(spark, d):
    def run(frames):
        for pdf in frames:
            yield pdf.assign(paragraphs=[sum(1 for _ in Marks(t).paragraphs(0, len(t))) for t in pdf["text"]])[["doc_id", "paragraphs"]]

    return load(spark, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, paragraphs long")


@query("v06_pending_embeddings", "SELECT doc_id AS document_id, 32 AS dim, TRUE AS unit FROM documents WHERE doc_id % 3 > 0 AND trim(text) <> ''")
def v06(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("abstract"))
    done = docs.where("document_id % 3 = 0").select("document_id", F.lit("m").alias("model"), F.lit("title_abstract").alias("scope"))
    made = embedding.embed_documents(docs, done, "m", lambda: embedding.hashing_encoder(32))
    unit = F.abs(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x) - 1) < 1e-5
    return made.select("document_id", "dim", unit.alias("unit"))


@query("v07_changed_full_text", "SELECT doc_id AS document_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE 'new' END AS state FROM documents WHERE trim(text) <> ''")
def v07(spark, d):
    docs = load(spark, d, "documents").where("trim(text) <> ''").select(F.col("doc_id").alias("document_id"), F.col("text").alias("body"))
    chunks = docs.where("document_id % 2 = 0").select("document_id", F.lit("m").alias("model"), F.when(F.col("document_id") % 4 == 0, F.sha2("body", 256)).otherwise("stale").alias("source_sha256"))
    fresh, kept = embedding.embed_full_text(docs, chunks, "m", lambda: embedding.hashing_encoder(8))
    return fresh.select("document_id", F.lit("new").alias("state")).union(kept.select("document_id", F.lit("old"))).distinct()


@query("v09_index_cache", "SELECT vec_id AS document_id, TRUE AS again, TRUE AS fresh FROM embeddings UNION ALL SELECT 1000000, TRUE, TRUE")
def v09(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit("m").alias("model"), F.lit("s").alias("scope"), F.lit(64).alias("dim"), F.col("embedding").alias("vector"))
    store = sinks.Store(spark, folder(spark))
    store.upsert("embeddings", e)
    cache = sinks.IndexCache(store)
    first = cache.get("m", "s")
    again = cache.get("m", "s") is first
    store.upsert("embeddings", e.limit(1).withColumn("document_id", F.lit(1000000).cast("long")))
    now = cache.get("m", "s")
    return now.select("document_id", F.lit(again).alias("again"), F.lit(now is not first).alias("fresh"))


@query("x09_relation_ingestion", "SELECT 'drug' || (l_partkey % 20) AS subject, 'drug' || (l_suppkey % 20) AS object, max(l_discount) AS confidence FROM lineitem WHERE l_discount >= 0.03 AND l_partkey % 20 <> l_suppkey % 20 GROUP BY 1, 2")
def x09(spark, d):
    l = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.col("l_partkey").alias("first"), F.col("l_suppkey").alias("second"), F.lit("Association").alias("type"), F.col("l_discount").alias("score"))
    ids = l.select(F.explode(F.array("first", "second")).alias("identifier")).distinct()
    edges, _ = enrichment.literature_edges(l, ids.select("identifier", F.concat(F.lit("drug"), (F.col("identifier") % 20).cast("string")).alias("node"), F.lit("drug").alias("kind")), 0.03)
    return edges.select("subject", "object", "confidence")


@query("x10_kept_ingestion", "SELECT 'kept' AS reason, count(*) AS n FROM supplier WHERE s_nationkey % 3 > 0 AND s_acctbal > 0 UNION ALL SELECT 'other topic', count(*) FROM supplier WHERE s_nationkey % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT 'no balance', count(*) FROM supplier WHERE s_nationkey % 3 > 0 AND s_acctbal <= 0 HAVING count(*) > 0")
def x10(spark, d):
    s = load(spark, d, "supplier")
    rows = common.conform(s.select(F.lit("euctr").alias("source"), F.col("s_suppkey").cast("string").alias("source_id"), F.col("s_nationkey").alias("year"), F.col("s_acctbal").cast("string").alias("abstract"), F.col("s_name").alias("title")), "documents")
    run, left = sinks.ingest_kept(sinks.Store(spark, folder(spark)), "documents", rows, {"other topic": F.col("year") % 3 > 0, "no balance": F.col("abstract").cast("double") > 0}, "euctr", "q")
    return left.union(spark.createDataFrame([("kept", run["inserted"])], "reason string, n long"))


@query("a08_agent_record", """
WITH r AS (SELECT l_partkey % 12 AS agent, 'S' || (l_orderkey % 50) AS study, CASE WHEN l_linenumber = 1 THEN 'S' || (l_orderkey % 50) ELSE 'R' || l_orderkey END AS sid, l_returnflag AS status, CASE l_linenumber % 3 WHEN 0 THEN 'PHASE_3' WHEN 1 THEN 'PHASE_2' END AS stage, CASE WHEN l_linestatus = 'F' THEN 'oral' ELSE 'topical' END AS route, CASE WHEN l_suppkey % 2 = 0 THEN 'Sp ' || (l_suppkey % 8) || ', Inc.' ELSE 'SP ' || (l_suppkey % 8) END AS sponsor, l_orderkey * 10 + l_linenumber AS o, l_quantity > 49 AS posted FROM lineitem),
st AS (SELECT agent, study, coalesce(max(CASE WHEN sid = study THEN status END), 'UNKNOWN') AS status, bool_or(posted) AS posted FROM r GROUP BY 1, 2), c AS (SELECT agent, status, count(*) AS n FROM st GROUP BY 1, 2), cs AS (SELECT agent, list(status || ':' || n ORDER BY n DESC, status) AS statuses FROM c GROUP BY 1), sp AS (SELECT agent, min(struct_pack(o := o, s := sponsor)) AS m FROM r GROUP BY agent, lower(regexp_extract(sponsor, '(?i)sp [0-9]'))), sl AS (SELECT agent, list(m.s ORDER BY m.o) AS sponsors FROM sp GROUP BY 1)
SELECT agent, count(*) AS records, max(stage) AS max_stage, list_sort(list(DISTINCT route)) AS routes, (SELECT count(*) FROM st WHERE st.agent = r.agent) AS studies, (SELECT count(*) FROM st WHERE st.agent = r.agent AND posted) AS with_results, any_value(statuses) AS statuses, any_value(sponsors) AS sponsors FROM r JOIN cs USING (agent) JOIN sl USING (agent) GROUP BY agent""")
def a08(spark, d):
    l = load(spark, d, "lineitem")
    study = F.concat(F.lit("S"), (F.col("l_orderkey") % 50).cast("string"))
    rows = l.select(
        (F.col("l_partkey") % 12).alias("agent"), study.alias("study_id"), F.when(F.col("l_linenumber") == 1, study).otherwise(F.concat(F.lit("R"), "l_orderkey")).alias("source_id"), F.col("l_returnflag").alias("status"),
        F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'PHASE_3' WHEN 1 THEN 'PHASE_2' END").alias("stage"), F.array(F.when(F.col("l_linestatus") == "F", "oral").otherwise("topical")).alias("routes"),
        F.expr("CASE WHEN l_suppkey % 2 = 0 THEN concat('Sp ', l_suppkey % 8, ', Inc.') ELSE concat('SP ', l_suppkey % 8) END").alias("sponsor"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), (F.col("l_quantity") > 49).alias("has_results"),
    )
    name = F.col("sponsor")  # as in the SQL, lines without a supplier have one sponsor, which has no name, and names without a digit after "SP" are one
    key = F.when(name.rlike("(?i)sp [0-9]"), sponsor_key(name)).when(name.isNotNull(), "")
    return aggregates.agent_summary(rows, key)


@query("g11_adverse_edges", """
WITH u AS (SELECT l_orderkey AS source_id, l_linenumber AS g, min(l_returnflag) AS f, min(l_quantity)::INTEGER % 4 AS a FROM lineitem GROUP BY 1, 2), c AS (SELECT source_id, list(a ORDER BY 'g' || g) AS versus FROM u WHERE f = 'N' GROUP BY 1) SELECT source_id, 'r' || f AS subject, 'rash' AS object, a AS affected, versus FROM u LEFT JOIN c USING (source_id) WHERE f = 'R' AND a > 0""")
def g11(spark, d):
    l = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("group_id")).agg(F.min("l_returnflag").alias("f"), (F.min("l_quantity").cast("int") % 4).alias("affected"))
    events = l.select("source_id", F.lit(0).alias("event_no"), F.lit(" rash ").alias("term"), F.lit(True).alias("serious"), "group_id", "affected", F.lit(50).alias("at_risk"))
    groups = l.select("source_id", "group_id", F.concat(F.lit("g"), "group_id").alias("title"), F.when(F.col("f") == "N", "placebo").otherwise("active").alias("role"), F.when(F.col("f") == "R", F.lit("rR")).alias("regimen"))
    return enrichment.adverse_edges(events, groups).select("source_id", "subject", "object", "affected", F.transform("versus", lambda v: v["affected"]).alias("versus"))


@query("g11_posted_rows", """
WITH u AS (SELECT l_orderkey AS source_id, l_linenumber AS g, min(l_returnflag) AS f, min(l_quantity) AS v FROM lineitem GROUP BY 1, 2), c AS (SELECT source_id, list(v ORDER BY 'g' || g) AS versus FROM u WHERE f = 'N' GROUP BY 1) SELECT source_id, 'r' || g AS subject, v AS value, CASE WHEN g % 2 = 0 THEN 10 * g ELSE 99 END AS n, versus FROM u LEFT JOIN c USING (source_id) WHERE f = 'R'""")
def g11b(spark, d):
    l = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("group_id")).agg(F.min("l_returnflag").alias("f"), F.min("l_quantity").alias("value"))
    one, none = F.lit(1).alias("measure_no"), F.lit(None).cast("string")
    cells = l.select("source_id", one, F.lit("Response").alias("title"), F.lit("percent").alias("unit"), F.lit("all").alias("class_title"), none.alias("category"), "group_id", "value")
    groups = l.select("source_id", "group_id", F.concat(F.lit("g"), "group_id").alias("group_title"), F.when(F.col("f") == "N", "placebo").otherwise("active").alias("role"), F.when(F.col("f") == "R", F.concat(F.lit("r"), "group_id")).alias("regimen"))
    whole = l.select("source_id", one, none.alias("class_title"), F.lit("Participants").alias("units"), "group_id", F.lit(99).alias("n"))
    own = l.where("group_id % 2 = 0").select("source_id", one, F.lit("all").alias("class_title"), none.alias("units"), "group_id", (F.col("group_id") * 10).alias("n"))
    lesions = l.select("source_id", one, F.lit("all").alias("class_title"), F.lit("Lesions").alias("units"), "group_id", F.lit(7).alias("n"))
    found = enrichment.posted_rows(cells, groups, whole.union(own).union(lesions))
    return found.select("source_id", "subject", "value", "n", F.transform("versus", lambda v: v["value"]).alias("versus"))


@query("w08_duplicate_flags", """
SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies, (SELECT count(DISTINCT lang || source) FROM documents b WHERE b.text = a.text) > 1 AS differ FROM documents a""")
def w08(spark, d):
    return ranking.duplicate_flags(load(spark, d, "documents"), "doc_id", F.col("text"), F.concat("lang", "source"))


@query("u02_union_priors", "SELECT s_name AS name, 'drug' AS kind, 'opentargets' AS source FROM supplier UNION ALL SELECT p_name, 'target', 'drugbank' FROM part")
def u02(spark, d):
    drugs = load(spark, d, "supplier").select(F.lit("opentargets").alias("source"), F.lit("drug").alias("kind"), F.col("s_suppkey").cast("string").alias("source_id"), F.col("s_name").alias("name"), (F.col("s_acctbal") / 1e4).alias("score"))
    targets = load(spark, d, "part").select(F.lit("drugbank").alias("source"), F.lit("target").alias("kind"), F.col("p_partkey").cast("string").alias("source_id"), F.col("p_name").alias("name"))
    return common.union_all([common.conform(x, "priors") for x in (drugs, targets)]).select("name", "kind", "source")


@query("x03_atlas_record", """
SELECT s_suppkey::VARCHAR AS source_id, CASE s_suppkey % 4 WHEN 0 THEN ['ruxo'] WHEN 1 THEN ['ruxo', 'upa'] ELSE [] END AS agents, CASE s_suppkey % 4 WHEN 0 THEN ['topical'] WHEN 1 THEN ['oral', 'topical'] ELSE [] END AS routes, CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END::INTEGER AS interventions, CASE s_suppkey % 4 WHEN 0 THEN FALSE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS phototherapy FROM supplier""")
def x03(spark, d):
    item = lambda name, text: F.struct(F.lit(name).alias("name"), F.lit(text).alias("description"))
    k = F.col("s_suppkey") % 4
    given = F.when(k == 0, F.array(item("Ruxolitinib", "1.5% cream BID"), item("Vehicle", "matching tablet"))).when(k == 1, F.array(item("ruxolitinib gel", "x"), item("Upadacitinib", "Oral dose"))).when(k == 2, F.array(item("Narrow-band", "NB-UVB twice a week")))
    trials = load(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), given.alias("interventions"))
    return ingestion.atlas_record(trials, {"ruxo": ("ruxolitinib",), "upa": ("upadacitinib",)})


@query("x12_watch_feeds", """
WITH h AS (SELECT 'orders' AS feed, o_orderkey::VARCHAR AS id, 'Study of drug' || (o_custkey % 3) AS title, o_orderdate::DATE AS date FROM orders UNION ALL SELECT 'events', event_id::VARCHAR, event_type, ts::DATE FROM events) SELECT feed, id, title, CASE WHEN title LIKE '%drug1' THEN ['one'] ELSE [] END AS agents FROM h WHERE date >= DATE '1995-06-01' ORDER BY date DESC, feed, id LIMIT 200""")
def x12(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Study of drug"), (F.col("o_custkey") % 3).cast("string")).alias("title"), F.to_date("o_orderdate").alias("date"))
    events = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.to_date("ts").alias("date"))
    return ingestion.watch({"orders": orders, "events": events}, "1995-06-01", {"one": ("drug1",)}, 200).select("feed", "id", "title", "agents")


@query("c12_redacted_export", "SELECT s_suppkey::VARCHAR AS \"TrialID\", 'Fund of [email removed], tel. [phone removed]' AS \"Source_Support\" FROM supplier")
def c12(spark, d):
    said = F.concat(F.lit("Fund of a"), F.col("s_suppkey").cast("string"), F.lit("@x.org, tel. +1 555 100 2000"))
    rows = load(spark, d, "supplier").select(F.col("s_suppkey").alias("TrialID"), said.alias("Source_Support"), F.col("s_name").alias("Contact_Firstname"))
    return registries.redacted_export(rows, ("TrialID", "Source_Support", "Phase"))


@query("c12_personal_grids", "SELECT s_suppkey, '<td></td><span id=\"DataList3_ctl01_TitleLabel\">Of ' || s_suppkey || ', phone: [phone removed]</span>' AS html FROM supplier")
def c12b(spark, d):
    page = F.concat(F.lit('<td><span id="DataList2_ctl01_NameLabel">'), "s_name", F.lit('\nStreet</span></td><span id="DataList3_ctl01_TitleLabel">Of '), F.col("s_suppkey").cast("string"), F.lit(", phone: 555 100 2000</span>"))
    return load(spark, d, "supplier").select("s_suppkey", registries.strip_personal(page, ("DataList2", "DataList20")).alias("html"))


@query("m14_checked_forecasts", "SELECT s_suppkey AS key, unnest(CASE s_suppkey % 5 WHEN 0 THEN ['the seal does not match'] WHEN 1 THEN ['quantiles are not in order'] WHEN 2 THEN ['quantiles are not in order', 'a rate is beyond 0 and 1'] WHEN 3 THEN ['frozen after the outcome'] ELSE [] END) AS problem FROM supplier")
def m14(spark, d):
    k = F.col("s_suppkey") % 5
    f = load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("key"), F.when(k == 3, F.lit("2024-05-01")).otherwise("2024-01-01").cast("date").alias("frozen_at"), F.col("s_name").alias("payload"), F.when(k == 0, "0").otherwise(F.sha2("s_name", 256)).alias("sha256"),
        F.lit(0.5).alias("mean"), F.when(k == 1, 0.9).otherwise(0.5).alias("median"), F.lit(0.1).alias("lo95"), F.lit(0.2).alias("lo80"), F.lit(0.8).alias("hi80"), F.when(k == 2, 1.2).otherwise(0.9).alias("hi95"),
    ).withColumn("lo95", F.when(F.col("hi95") > 1, 0.3).otherwise(F.col("lo95")))
    posted = load(spark, d, "supplier").where("s_suppkey % 5 <> 4").select(F.col("s_suppkey").alias("key"), F.lit("2024-03-01").cast("date").alias("posted_at"))
    return discovery.check_forecasts(f, posted)
