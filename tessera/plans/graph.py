"""Queries over the graph operators (inventory G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.stats import exact_mean
from tessera.operators import graph, links
from tessera.plans.registry import load, query


@query("g01_entity_merge", """
WITH r AS (SELECT 'part' AS kind, string_split(p_name, ' ')[1] AS key, p_name AS name, p_partkey AS o, p_brand, p_size FROM part),
n AS (SELECT kind, key, arg_max(name, struct_pack(l := len(name), o := o)) AS name FROM r GROUP BY 1, 2),
f AS (SELECT kind, key, alias, min(o) AS o FROM (SELECT kind, key, o, name AS alias FROM r UNION ALL SELECT kind, key, o, p_brand FROM r) GROUP BY 1, 2, 3),
a AS (SELECT kind, key, list(alias ORDER BY o, alias)[1:30] AS aliases FROM f GROUP BY 1, 2), x AS (SELECT kind, key, arg_max(p_size, o)::VARCHAR AS last_size FROM r GROUP BY 1, 2)
SELECT kind, key, name, aliases, last_size FROM n JOIN a USING (kind, key) JOIN x USING (kind, key)""")
def g01(spark, d):
    rows = load(spark, d, "part").select(F.lit("part").alias("kind"), F.split("p_name", " ")[0].alias("key"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("external_ids"), F.col("p_partkey").alias("ordinal"))
    return graph.merge_entities(rows).select("kind", "key", "name", "aliases", F.col("external_ids")["size"].alias("last_size"))


@query("g02_edge_merge", """
WITH r AS (SELECT l_suppkey AS subject, l_returnflag AS predicate, l_partkey AS object, l_discount AS c, CASE WHEN l_linestatus = 'F' THEN 'observed' ELSE 'asserted' END AS claim, l_linenumber % 3 AS lv, l_orderkey * 10 + l_linenumber AS o, l_shipdate::DATE::VARCHAR AS ev FROM lineitem)
SELECT subject, predicate, object, max(c) AS confidence, CASE WHEN bool_or(claim = 'observed') THEN 'observed' ELSE 'asserted' END AS claim, CASE max(lv) FILTER (WHERE claim = 'observed') WHEN 0 THEN 'association' WHEN 1 THEN 'perturbation_in_vitro' WHEN 2 THEN 'perturbation_in_human' END AS causal_level, 'm' || (arg_min(o, o) % 10) AS extraction_method, count(DISTINCT ev) AS n_evidence FROM r GROUP BY 1, 2, 3""")
def g02(spark, d):
    l = load(spark, d, "lineitem")
    rows = l.select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("predicate"), F.col("l_partkey").alias("object"), F.col("l_discount").alias("confidence"), F.when(F.col("l_linestatus") == "F", "observed").otherwise("asserted").alias("claim"), F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'association' WHEN 1 THEN 'perturbation_in_vitro' ELSE 'perturbation_in_human' END").alias("causal_level"), F.concat(F.lit("m"), F.col("l_linenumber")).alias("extraction_method"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("evidence"))
    return graph.merge_edges(rows).select("subject", "predicate", "object", "confidence", "claim", "causal_level", "extraction_method", F.size("evidence").cast("long").alias("n_evidence"))


_EV = "SELECT DISTINCT l_suppkey AS subject, l_returnflag AS predicate, l_partkey % 50 AS object, l_linestatus AS source_type, l_linenumber AS ref FROM lineitem"


@query("g03_replace_evidence", f"SELECT * FROM ({_EV}) WHERE source_type <> 'F' UNION ALL SELECT subject, 'N', object, 'F', 9 FROM (SELECT DISTINCT subject, object FROM ({_EV}) WHERE source_type = 'F' AND object < 5)")
def g03(spark, d):
    e = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("predicate"), (F.col("l_partkey") % 50).alias("object"), F.col("l_linestatus").alias("source_type"), F.col("l_linenumber").alias("ref")).distinct()
    wanted = e.where("source_type = 'F' AND object < 5").select("subject", F.lit("N").alias("predicate"), "object", F.lit(9).alias("ref")).distinct()
    return graph.replace_evidence(e, "F", wanted)


@query("g03_orphans", "WITH b AS (SELECT o_orderkey AS s, 100000 + o_custkey AS o FROM orders), a AS (SELECT * FROM b WHERE s % 3 > 0), n AS (SELECT s AS node FROM b UNION SELECT o FROM b), m AS (SELECT s AS node FROM a UNION SELECT o FROM a) SELECT node FROM n EXCEPT SELECT node FROM m")
def g03b(spark, d):
    b = load(spark, d, "orders").select(F.col("o_orderkey").alias("subject"), (F.col("o_custkey") + 100000).alias("object"))
    return graph.orphans(b, b.where("subject % 3 > 0"))


@query("g04_seed_structured", """
SELECT s_name AS subject, 'treats' AS predicate, 'disease' AS object, CASE WHEN s_suppkey % 2 = 0 THEN 0.88 ELSE 0.82 END::DOUBLE AS confidence FROM supplier UNION ALL SELECT s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'inhibits' ELSE 'targets' END, 'T' || s_nationkey, 0.84 FROM supplier UNION ALL SELECT p_name, 'associated_with', 'disease', least(0.95, 0.45 + p_size / 100.0) FROM part UNION ALL SELECT 'd' || l_returnflag, 'tested_in', 'ct:' || l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 0.8 ELSE 0.78 END FROM lineitem WHERE l_linestatus = 'F'""")
def g04(spark, d):
    s = load(spark, d, "supplier")
    mech = F.array(F.struct(F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'Inhibitor' ELSE 'binder' END").alias("action_type"), F.array(F.struct(F.concat(F.lit("T"), "s_nationkey").alias("symbol"))).alias("targets")))
    drugs = s.select(F.lit("drug").alias("kind"), F.col("s_name").alias("name"), F.expr("CASE s_suppkey % 2 WHEN 0 THEN 'PHASE_3' ELSE 'PHASE_2' END").alias("clinical_stage"), F.lit(None).cast("double").alias("score"), mech.alias("mechanisms"), F.lit("ot").alias("source"), F.col("s_suppkey").cast("string").alias("source_id"))
    targets = load(spark, d, "part").select(F.lit("target").alias("kind"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("clinical_stage"), (F.col("p_size") / 100.0).alias("score"), F.lit(None).cast(drugs.schema["mechanisms"].dataType).alias("mechanisms"), F.lit("ot").alias("source"), F.col("p_partkey").cast("string").alias("source_id"))
    given = F.struct(F.expr("CASE l_linestatus WHEN 'F' THEN 'Drug' ELSE 'Device' END").alias("type"), F.concat(F.lit("d"), "l_returnflag").alias("name"))
    trials = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(given).alias("interventions"))
    trials = trials.select(F.lit("ct").alias("source"), F.col("l_orderkey").cast("string").alias("source_id"), (F.col("l_orderkey") % 2 == 0).alias("has_results"), "interventions")
    return graph.seed_structured(drugs.unionByName(targets), trials, "disease").select("subject", "predicate", "object", "confidence")


@query("g06_genetics_edges", "SELECT g AS subject, min(p) AS p FROM (SELECT unnest(string_split(p_type, ' ')) AS g, (p_size - 1) * 1e-9 AS p FROM part) WHERE p < 5e-8 GROUP BY 1")
def g06(spark, d):
    rows = load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source_id"), ((F.col("p_size") - 1) * 1e-9).alias("p_value"), F.replace(F.col("p_type"), F.lit(" "), F.lit(" , ")).alias("mapped_gene"))
    edges = graph.genetics_edges(rows, "disease")
    return edges.join(rows.select(F.col("source_id").alias("evidence"), "p_value"), "evidence").select("subject", F.col("p_value").alias("p"))


@query("g08_expression_edges", """
WITH a AS (SELECT l_partkey AS gene, sign(l_quantity - 25) AS s, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1, 2) SELECT gene AS subject, CASE WHEN max(n) >= 2 THEN 0.85 ELSE 0.65 END::DOUBLE AS confidence FROM a GROUP BY 1""")
def g08(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), (F.col("l_quantity") - 25).alias("change"), F.col("l_returnflag").alias("series"))
    return graph.expression_edges(rows, "disease").select("subject", "confidence")


@query("g15_undirected_pairs", "SELECT a, b, max(w) AS weight FROM (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_extendedprice AS w FROM lineitem WHERE l_partkey <> l_suppkey) GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 1500")
def g15(spark, d):
    return graph.undirected(load(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice"), "l_partkey", "l_suppkey", "l_extendedprice", 1500)


_EDGES = "SELECT o_orderkey AS edge_id, o_custkey AS subject_id, 100000 + o_orderkey % 500 AS object_id, o_totalprice AS confidence FROM orders"


@query("g17_neighbours_2hop", f"""
WITH e AS ({_EDGES}), h1 AS (SELECT * FROM e WHERE subject_id = 7 OR object_id = 7 ORDER BY confidence DESC, edge_id LIMIT 100), f AS (SELECT subject_id AS node FROM h1 UNION SELECT object_id FROM h1 EXCEPT SELECT 7),
h2 AS (SELECT * FROM e WHERE subject_id IN (SELECT node FROM f) OR object_id IN (SELECT node FROM f) ORDER BY confidence DESC, edge_id LIMIT 100) SELECT * FROM (SELECT * FROM h1 UNION SELECT * FROM h2) ORDER BY confidence DESC, edge_id LIMIT 50""")
def g17(spark, d):
    e = load(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("subject_id"), (F.col("o_orderkey") % 500 + 100000).alias("object_id"), F.col("o_totalprice").alias("confidence"))
    return graph.neighbours(e, spark.createDataFrame([(7,)], "node long"), 2, 50)


@query("g18_components", """
WITH RECURSIVE l AS (SELECT o_custkey AS a, 10000000 + o_orderkey // 3 AS b FROM orders), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(node, label) USING KEY (node) AS (
  SELECT a, least(a, min(b)) FROM e GROUP BY a UNION SELECT e.a, min(r.label) FROM r JOIN e ON e.b = r.node JOIN recurring.r AS k ON k.node = e.a WHERE r.label < k.label GROUP BY e.a) SELECT node, label FROM r""")
def g18(spark, d):
    links = load(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.expr("10000000 + o_orderkey div 3").alias("b"))
    return graph.components(links)


@query("g18_linked_records", """
WITH RECURSIVE rec AS (SELECT c_custkey AS id, c_nationkey % 3 AS source FROM customer), l AS (SELECT a.id AS a, b.id AS b FROM rec a JOIN rec b ON b.id = a.id + 7 WHERE a.id % 5 = 0 AND a.source <> b.source), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT id AS x, id AS y FROM rec UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), g AS (SELECT x AS id, min(y) AS label FROM r GROUP BY 1), p AS (SELECT label, arg_min(rec.id, struct_pack(s := -source, i := rec.id)) AS representative FROM g JOIN rec USING (id) GROUP BY 1) SELECT rec.id, source, representative FROM rec JOIN g USING (id) JOIN p USING (label)""")
def g18b(spark, d):
    rec = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("source"))
    n = rec.agg(F.max("id")).scalar()
    links = rec.where("id % 5 = 0").select(F.col("id").alias("a"), (F.col("id") + 7).alias("b")).withColumn("n", n).where("b <= n").drop("n")
    return graph.linked_records(rec, links, -F.col("source"))


@query("g19_triples", """
WITH e AS (SELECT DISTINCT n_name AS s, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey), n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT s AS name FROM e UNION SELECT o FROM e)) SELECT e.s AS subject, e.o AS object, a.id AS s, b.id AS o, dense_rank() OVER (ORDER BY left(e.o, 2)) - 1 AS p FROM e JOIN n a ON a.name = e.s JOIN n b ON b.name = e.o""")
def g19(spark, d):
    r = load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    e = load(spark, d, "nation").join(r, "n_regionkey").select(F.col("n_name").alias("subject"), F.concat(F.lit("in "), F.substring("r_name", 1, 2)).alias("predicate"), F.col("r_name").alias("object")).distinct()
    return graph.triple_ids(e).select("subject", "object", "s", "o", "p")


@query("g20_complex_score", """
WITH v AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS re, embedding[33:64]::DOUBLE[] AS im FROM embeddings), q AS (SELECT re AS hr, im AS hi FROM v WHERE vec_id = 0), r AS (SELECT re AS rr, im AS ri FROM v WHERE vec_id = 1)
SELECT vec_id, list_sum([(hr[i]*rr[i] - hi[i]*ri[i]) * re[i] + (hr[i]*ri[i] + hi[i]*rr[i]) * im[i] for i in range(1, 33)]) AS score FROM v, q, r""")
def g20(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 32).alias("re"), F.slice(F.col("embedding").cast("array<double>"), 33, 32).alias("im"))
    fixed = {r.vec_id: r for r in e.where("vec_id IN (0, 1)").collect()}  # two vectors
    lit = lambda x: F.array(*[F.lit(float(v)) for v in x])
    h, r = fixed[0], fixed[1]
    return e.select("vec_id", graph.complex_score(lit(h.re), lit(h.im), lit(r.re), lit(r.im), F.col("re"), F.col("im")).alias("score"))


@query("g21_reverse_screen", """
WITH s AS (SELECT l_suppkey AS drug, l_partkey % 20 AS target, avg(l_discount) * 10 AS score, max(l_quantity) >= 50 AND l_suppkey % 3 = 0 AS sure FROM lineitem GROUP BY 1, 2), b AS (SELECT target, greatest(quantile_cont(score, 0.88), 0.5) AS bar FROM s GROUP BY 1), m AS (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY score DESC) AS n FROM s JOIN b USING (target)),
p AS (SELECT drug, avg(score) FILTER (WHERE n <= 3) AS mean, count(*) FILTER (WHERE sure) AS sure, coalesce(list(target || CASE WHEN sure THEN '*' ELSE '' END ORDER BY score + CASE WHEN sure THEN 2 ELSE 0 END DESC) FILTER (WHERE sure OR score >= bar), [])[1:5] AS matches FROM m GROUP BY 1),
t AS (SELECT drug, 'n' || (drug % 70) AS name, matches, 0.6 * (mean + 0.35 * least(sure, 3)) + 0.4 * (s_acctbal / 10000 - 0.75 * greatest(0, s_nationkey / 25.0 - 0.5)) + CASE WHEN drug % 5 = 0 THEN 0.45 ELSE 0 END AS score FROM p JOIN supplier ON s_suppkey = drug),
o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, drug) AS k FROM t) SELECT drug, name, score, matches, row_number() OVER (ORDER BY score DESC, drug) AS rank FROM o WHERE k = 1""")
def g21(spark, d):
    l = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("drug"), (F.col("l_partkey") % 20).alias("target"))
    s = l.agg((exact_mean("l_discount") * 10).alias("score"), F.max("l_quantity").alias("q"))
    overall = load(spark, d, "supplier").select(F.col("s_suppkey").alias("drug"), F.concat(F.lit("n"), (F.col("s_suppkey") % 70).cast("string")).alias("name"), (F.col("s_acctbal") / 10000).alias("treats"), (F.col("s_nationkey") / 25.0 - 0.5).alias("causes"), F.when(F.col("s_suppkey") % 5 == 0, 0.45).otherwise(0.0).alias("adjustment"))
    return links.screen(s.drop("q"), s.where("q >= 50 AND drug % 3 = 0").select("drug", "target"), overall)
