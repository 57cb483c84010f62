"""Queries over joins (inventory J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import joins
from tessera.plans.registry import load, query


@query("j01_hits_to_documents", """
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS raw FROM embeddings e, q ORDER BY raw DESC, vec_id LIMIT 15) SELECT vec_id, raw, lang, source FROM s JOIN documents ON doc_id = vec_id""")
def j01(spark, d):
    e = load(spark, d, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").select("embedding").first()[0]]
    top = e.select("vec_id", vector.dot(F.col("embedding"), vector.literal(q)).alias("raw")).orderBy(F.desc("raw"), "vec_id").limit(15)
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return docs.join(F.broadcast(top), "vec_id").select("vec_id", "raw", "lang", "source")  # 15 rows


@query("j02_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j02(spark, d):
    return joins.pending(load(spark, d, "documents").select("doc_id"), load(spark, d, "labels"), ["doc_id"])


@query("j03_changed_text", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def j03(spark, d):
    now = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    known = now.where("doc_id % 7 <> 0").withColumn("sha", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("sha")))
    return joins.changed(now, known, "doc_id", "sha").select("doc_id")


@query("j04_edge_two_ends", """
SELECT n_name, s_name, count(*) AS n, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def j04(spark, d):
    l = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    both = l.join(o, "l_orderkey").join(c, "o_custkey").join(load(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").join(s, "l_suppkey")
    return both.groupBy("n_name", "s_name").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("j05_incident_edges", "SELECT o_orderkey AS edge_id FROM orders WHERE o_custkey IN (1, 2, 3, 10) OR o_orderkey % 1000 IN (1, 2, 3, 10)")
def j05(spark, d):
    edges = load(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("subject_id"), (F.col("o_orderkey") % 1000).alias("object_id"))
    frontier = spark.createDataFrame([(1,), (2,), (3,), (10,)], "node long")
    return joins.incident(edges, frontier).select("edge_id")


@query("j06_own_control", """
WITH c AS (SELECT user_id, max(value) AS control FROM events WHERE event_type = 'view' GROUP BY 1) SELECT event_id, value, control, value - control AS difference FROM events LEFT JOIN c USING (user_id) WHERE event_type = 'purchase'""")
def j06(spark, d):
    e = load(spark, d, "events")
    control = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("control"))
    return e.where("event_type = 'purchase'").join(control, "user_id", "left").select("event_id", "value", "control", (F.col("value") - F.col("control")).alias("difference"))


@query("j07_other_trials", """
WITH a AS (SELECT user_id % 20 AS t, avg(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1), c AS (SELECT user_id % 20 AS t, avg(value) AS w FROM events WHERE event_type = 'view' GROUP BY 1) SELECT x.t AS trial, count(*) AS n, avg(a.v - c.w) AS effect FROM (SELECT t FROM a) x JOIN a ON a.t <> x.t JOIN c ON c.t = a.t GROUP BY 1""")
def j07(spark, d):
    e = load(spark, d, "events").withColumn("t", F.col("user_id") % 20)
    mean = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("t").agg(F.avg("value").alias(name))
    effect = mean("purchase", "v").join(mean("view", "w"), "t").select("t", (F.col("v") - F.col("w")).alias("x"))
    # All trials but one's own: totals less the own value, no join of all with all.
    total = effect.agg(F.struct(F.count("*").alias("n"), F.sum("x").alias("x")))
    return effect.withColumn("all", total.scalar()).select(F.col("t").alias("trial"), (F.col("all.n") - 1).alias("n"), ((F.col("all.x") - F.col("x")) / (F.col("all.n") - 1)).alias("effect"))


@query("j08_regimen_pairs", """
SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity >= b.l_quantity AND a.l_discount >= b.l_discount AND (a.l_quantity > b.l_quantity OR a.l_discount > b.l_discount)""")
def j08(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return joins.in_order(rows, ["l_orderkey"], "l_linenumber", ["l_quantity", "l_discount"])


@query("j09_names_in_texts", r"""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents), n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) SELECT token, count(*) AS docs FROM w JOIN n USING (token) GROUP BY 1""")
def j09(spark, d):
    names = load(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    return joins.words_in_texts(names, load(spark, d, "documents"), "token", "doc_id", "text").groupBy("token").agg(F.count("*").alias("docs"))


_SIDES = "SELECT l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN l_returnflag END AS flag FROM lineitem WHERE l_linenumber = "


@query("j10_null_safe_match", f"""
WITH a AS (SELECT DISTINCT * FROM ({_SIDES} 1)), b AS (SELECT DISTINCT * FROM ({_SIDES} 2)) SELECT 'match' AS kind, count(*) AS n FROM a JOIN b ON a.l_partkey = b.l_partkey AND a.flag IS NOT DISTINCT FROM b.flag UNION ALL SELECT 'new', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.l_partkey = b.l_partkey AND a.flag IS NOT DISTINCT FROM b.flag)""")
def j10(spark, d):
    side = lambda n: load(spark, d, "lineitem").where(F.col("l_linenumber") == n).select("l_partkey", "l_suppkey", F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("flag")).distinct()
    a, b = side(1), side(2)
    match = joins.null_safe(a, b.withColumnRenamed("l_suppkey", "other"), ["l_partkey", "flag"], "inner").agg(F.count("*").alias("n")).select(F.lit("match").alias("kind"), "n")
    new = joins.null_safe(a, b.select("l_partkey", "flag"), ["l_partkey", "flag"], "left_anti").agg(F.count("*").alias("n")).select(F.lit("new").alias("kind"), "n")
    return match.union(new)


@query("j11_overlap", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def j11(spark, d):
    big = load(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_semi")


@query("j12_cross_registry_skip", """
WITH n AS (SELECT l_suppkey AS owner, 'P' || (100000 + l_partkey) AS number FROM lineitem WHERE l_linenumber = 1), one AS (SELECT number, min(owner) AS owner FROM n GROUP BY 1 HAVING count(DISTINCT owner) = 1) SELECT p_partkey FROM part WHERE 'P' || (100000 + p_partkey) NOT IN (SELECT number FROM one)""")
def j12(spark, d):
    numbers = load(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("owner"), F.concat(F.lit("P"), F.col("l_partkey") + 100000).alias("number"))
    own = joins.own_by_protocol(numbers)
    return load(spark, d, "part").select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey") + 100000).alias("number")).join(own, "number", "left_anti").select("p_partkey")


@query("j14_tests_with_hypotheses", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def j14(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return load(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "c_name", "o_totalprice").orderBy("o_orderkey")


@query("j16_unregistered", "SELECT doc_id FROM documents WHERE doc_id % 10 NOT IN (3, 4) AND doc_id % 15 NOT IN (3, 4)")
def j16(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    held = spark.createDataFrame([(3,), (4,)], "id long")
    return joins.not_registered(docs, held, "doc_id", F.array(F.col("doc_id") % 10, F.col("doc_id") % 15))


@query("j20_tolerance", """
WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1) SELECT o_orderkey FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.o_custkey = b.o_custkey AND abs(a.o_totalprice - b.o_totalprice) <= 5000)""")
def j20(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.within_tolerance(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_totalprice", "o_totalprice", 5000.0, ["o_custkey"]).select("o_orderkey")


@query("j23_central_precedence", "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_linestatus = 'F' OR NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_returnflag = a.l_returnflag AND b.l_linestatus = 'F')")
def j23(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    central = F.max(F.col("l_linestatus") == "F").over(Window.partitionBy("l_partkey", "l_returnflag"))
    return rows.withColumn("central", central).where("l_linestatus = 'F' OR NOT central").select("l_orderkey", "l_linenumber")


@query("j24_pathway_membership", """
WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem JOIN (SELECT p_partkey FROM part WHERE p_size <= 10) ON l_partkey = p_partkey), s AS (SELECT l_suppkey FROM p GROUP BY 1 HAVING count(*) BETWEEN 50 AND 130) SELECT l_suppkey, l_partkey FROM p JOIN s USING (l_suppkey)""")
def j24(spark, d):
    members = load(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return joins.sets_of_size(load(spark, d, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey", members, 50, 130).select("l_suppkey", "l_partkey")
