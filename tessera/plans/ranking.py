"""Queries over windows, top-k and set operations (inventory W, T, U, V8) and the flagship search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import ordering, ranking
from tessera.plans.registry import load, query

#: Rows of a label rank lower by this much; labels stand for evidence levels.
PENALTY = "CASE WHEN label % 4 = 0 THEN 0.08 WHEN label % 4 = 1 THEN 0.05 ELSE 0 END"


def scored(spark, d):
    """Embeddings scored against vector 0 (one row, read on its own)."""
    e = load(spark, d, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").select("embedding").first()[0]]
    return e.where("vec_id <> 0").select("vec_id", "label", vector.scores(F.col("embedding"), q).alias("raw"))


_SCORED = "SELECT e.vec_id, e.label, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS raw FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0"


@query("semantic_topk", f"SELECT vec_id, label, raw, raw - {PENALTY} AS adjusted FROM ({_SCORED}) ORDER BY adjusted DESC, raw DESC, vec_id LIMIT 10")
def t01(spark, d):
    return ranking.top_with_penalty(scored(spark, d), "raw", F.expr(PENALTY), "vec_id", 10)


@query("t02_shortlist", f"WITH s AS ({_SCORED}) SELECT vec_id, raw FROM s WHERE raw >= (SELECT min(raw) FROM (SELECT raw FROM s ORDER BY raw DESC LIMIT 10)) - 0.08")
def t02(spark, d):
    return ranking.shortlist(scored(spark, d), "raw", 10, 0.08).select("vec_id", "raw")


@query("t03_best_passage", f"SELECT label, vec_id, raw FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY raw DESC, vec_id) AS n FROM ({_SCORED})) WHERE n = 1 ORDER BY raw DESC, label LIMIT 5")
def t03(spark, d):
    return ranking.best_per_key(scored(spark, d), ["label"], [F.desc("raw"), F.col("vec_id")]).orderBy(F.desc("raw"), "label").limit(5).select("label", "vec_id", "raw")


@query("w14_best_passage_all", f"SELECT label, arg_max(vec_id, raw) AS vec_id, max(raw) AS raw FROM ({_SCORED}) GROUP BY label")
def w14(spark, d):
    return scored(spark, d).groupBy("label").agg(F.max_by("vec_id", F.struct("raw", -F.col("vec_id"))).alias("vec_id"), F.max("raw").alias("raw"))


@query("w18_true_rank", f"WITH s AS ({_SCORED}) SELECT label, 1 + count(*) FILTER (WHERE raw > t) AS rank FROM (SELECT s.*, x.t FROM s, (SELECT raw AS t FROM s WHERE vec_id = 7) x) GROUP BY label")
def w18(spark, d):
    s = scored(spark, d)
    truth = s.where("vec_id = 7").agg(F.max("raw")).scalar()
    return s.withColumn("t", truth).groupBy("label").agg((1 + F.count_if(F.col("raw") > F.col("t"))).alias("rank"))


@query("v05_normalised_vectors", "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS unit FROM embeddings")
def v05(spark, d):
    return load(spark, d, "embeddings").select("vec_id", vector.normalised(F.transform("embedding", lambda x: x.cast("double"))).alias("unit"))


@query("t04_relevant_documents", r"""
WITH t AS (SELECT unnest(['the', 'with', 'reth', 'queen']) AS token), hit AS (SELECT doc_id, token FROM documents, t WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || token)),
df AS (SELECT token, count(*) AS df FROM hit GROUP BY token), n AS (SELECT count(DISTINCT doc_id) AS n FROM hit), idf AS (SELECT token, ln((n.n + 1.0) / (df + 1.0)) + 1 AS idf FROM df, n)
SELECT doc_id, count(*) AS tokens, sum(idf) AS relevance FROM hit JOIN idf USING (token) GROUP BY doc_id ORDER BY round(relevance, 9) DESC, doc_id DESC LIMIT 25""")
def t04(spark, d):
    from tessera.operators.search import relevance

    return relevance(load(spark, d, "documents"), "doc_id", "text", ["the", "with", "reth", "queen"]).orderBy(F.desc(F.round("relevance", 9)), F.desc("doc_id")).limit(25)


@query("t05_case_order", """
SELECT p_partkey, p_name, CASE WHEN p_type LIKE '%STEEL%' THEN 3 WHEN p_type LIKE '%BRASS%' THEN 2 ELSE 1 END AS stage FROM part ORDER BY stage DESC, p_name, p_partkey LIMIT 40""")
def t05(spark, d):
    stage = F.when(F.contains("p_type", F.lit("STEEL")), 3).when(F.contains("p_type", F.lit("BRASS")), 2).otherwise(1)
    return load(spark, d, "part").select("p_partkey", "p_name", stage.alias("stage")).orderBy(F.desc("stage"), "p_name", "p_partkey").limit(40)


@query("t06_paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def t06(spark, d):
    return load(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(50).limit(25).select("o_orderkey", "o_totalprice")


@query("t07_evidence_order", """
SELECT row_number() OVER (ORDER BY l_linestatus, controlled DESC, -coalesce(diff, pct), l_returnflag) AS place, l_linestatus, l_returnflag, pct, diff FROM (
 SELECT l_linestatus, l_returnflag, avg(l_quantity) AS pct, CASE WHEN l_returnflag <> 'N' THEN avg(l_discount) END AS diff, l_returnflag <> 'N' AS controlled FROM lineitem GROUP BY 1, 2)""")
def t07(spark, d):
    g = load(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.avg("l_quantity").alias("pct"), F.avg("l_discount").alias("disc"))
    g = g.select("l_linestatus", "l_returnflag", "pct", F.when(F.col("l_returnflag") != "N", F.col("disc")).alias("diff"))
    order = Window.orderBy("l_linestatus", F.desc(F.col("l_returnflag") != "N"), -F.coalesce("diff", "pct"), "l_returnflag")
    return g.select(F.row_number().over(order).alias("place"), "*")


@query("t08_candidate_order", """
SELECT row_number() OVER (ORDER BY total DESC, stage DESC, n DESC, c_custkey) AS rank, c_custkey, total, stage, n FROM (SELECT c_custkey, floor(c_acctbal / 1000)::BIGINT AS total, c_nationkey AS stage, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) ORDER BY total DESC, stage DESC, n DESC, c_custkey LIMIT 20""")
def t08(spark, d):
    n = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = load(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.floor(F.col("c_acctbal") / 1000).alias("total"), F.col("c_nationkey").alias("stage"), F.coalesce("n", F.lit(0)).alias("n"))
    order = [F.desc("total"), F.desc("stage"), F.desc("n"), F.col("c_custkey")]
    return c.orderBy(*order).limit(20).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query("t09_group_order", """
SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best FROM lineitem""")
def t09(spark, d):
    best = F.max("l_quantity").over(Window.partitionBy("l_orderkey"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", best.alias("best")).orderBy(F.desc("best"), "l_orderkey", F.desc("l_quantity"), "l_linenumber")


@query("w01_best_row_per_cell", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag, l_suppkey ORDER BY l_quantity DESC, l_linestatus, l_orderkey, l_linenumber) AS n FROM lineitem), t AS (SELECT * FROM r WHERE n = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_quantity DESC, l_linestatus, l_orderkey, l_linenumber) AS m, count(*) OVER (PARTITION BY l_partkey, l_returnflag) AS trials FROM t)
SELECT l_partkey, l_returnflag, l_suppkey, l_quantity, l_orderkey, l_linenumber, trials - 1 AS others FROM w WHERE m = 1""")
def w01(spark, d):
    order = [F.desc("l_quantity"), F.col("l_linestatus"), F.col("l_orderkey"), F.col("l_linenumber")]
    trial = ranking.best_per_key(load(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_suppkey", "l_quantity", "l_linestatus", "l_orderkey", "l_linenumber"), ["l_partkey", "l_returnflag", "l_suppkey"], order)
    cell = Window.partitionBy("l_partkey", "l_returnflag")
    best = trial.withColumns({"others": F.count("*").over(cell) - 1, "m": F.row_number().over(cell.orderBy(*order))}).where("m = 1")
    return best.select("l_partkey", "l_returnflag", "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "others")


@query("w02_best_control", "SELECT o_custkey, o_orderpriority, max(o_totalprice) AS best, arg_max(o_orderkey, o_totalprice) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def w02(spark, d):
    return load(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("best"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("w03_largest_arm", "SELECT l_suppkey, l_returnflag, max(l_quantity) AS n, min(l_orderkey) FILTER (WHERE l_quantity = m) AS l_orderkey FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag) AS m FROM lineitem) GROUP BY 1, 2")
def w03(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.max("l_quantity").alias("n"), F.max_by("l_orderkey", F.struct("l_quantity", -F.col("l_orderkey"))).alias("l_orderkey"))


@query("w04_strongest_association", """
WITH g AS (SELECT unnest(string_split(p_type, ' ')) AS gene, p_partkey, (p_size - 1) / 100.0 AS p FROM part) SELECT gene, p_partkey, p FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY p, p_partkey) AS n FROM g) WHERE n = 1""")
def w04(spark, d):
    # A p-value of 0 is the strongest there is, not a missing one.
    g = load(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("gene"), "p_partkey", ((F.col("p_size") - 1) / 100.0).alias("p"))
    return g.groupBy("gene").agg(F.min_by("p_partkey", F.struct("p", "p_partkey")).alias("p_partkey"), F.min("p").alias("p"))


@query("w05_largest_control", "SELECT * EXCLUDE n FROM (SELECT l_suppkey, l_linenumber, l_quantity, l_orderkey, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_quantity DESC, l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'N') WHERE n = 1")
def w05(spark, d):
    rows = load(spark, d, "lineitem").where("l_returnflag = 'N'").select("l_suppkey", "l_linenumber", "l_quantity", "l_orderkey")
    return ranking.best_per_key(rows, ["l_suppkey", "l_linenumber"], [F.desc("l_quantity"), F.col("l_orderkey")])


@query("w06_latest_later", """
WITH chosen AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, max(ts) AS last_ts, arg_max(event_id, struct_pack(ts := ts, e := event_id)) AS event_id FROM events JOIN chosen USING (user_id) WHERE ts > t0 GROUP BY 1""")
def w06(spark, d):
    e = load(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    chosen = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0"))
    return e.join(chosen, "user_id").where("ts > t0").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("w07_other_reports", """
SELECT l_partkey, list_sort(list(l_suppkey) FILTER (WHERE n > 1)) AS others FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY max(l_quantity) DESC, l_suppkey) AS n FROM lineitem GROUP BY l_partkey, l_suppkey) GROUP BY 1 HAVING count(*) > 1""")
def w07(spark, d):
    per = load(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    ranked = per.withColumn("n", F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("q"), "l_suppkey")))
    return ranked.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("l_suppkey")))).alias("others")).where(F.size("others") > 0)


@query("w09_nested_min", """
SELECT l_orderkey, l_linenumber, min(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS nested, first_value(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n_first FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)""")
def w09(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")
    rows = ranking.best_per_key(rows, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    return rows.select("l_orderkey", "l_linenumber", ranking.running_min(rows, ["l_orderkey"], "l_linenumber", "l_quantity").alias("nested"), F.first("l_extendedprice").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("n_first"))


@query("w10_benjamini_hochberg", """
WITH p AS (SELECT o_orderkey, o_orderpriority, (o_orderkey * 7919 % 10007) / 10007.0 AS p FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS m FROM p)
SELECT o_orderkey, o_orderpriority, p, least(1.0, min(p * m / k) OVER (PARTITION BY o_orderpriority ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM r""")
def w10(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") * 7919 % 10007 / 10007.0).alias("p"))
    return ranking.adjusted_p(rows, "p", "o_orderkey", ["o_orderpriority"])


@query("w10_benjamini_hochberg_any_size", """
WITH p AS (SELECT o_orderkey, (o_orderkey * 7919 % 10007) / 10007.0 AS p FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY p, o_orderkey) AS k, count(*) OVER () AS m FROM p)
SELECT o_orderkey, p, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM r""")
def w10b(spark, d):
    return ordering.adjusted_p(load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 10007 / 10007.0).alias("p")), "p", "o_orderkey", [])


@query("w10_running_total", "SELECT l_orderkey, l_linenumber, l_returnflag, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS total, min(l_extendedprice) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS least FROM lineitem")
def w10c(spark, d):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    rows = load(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return ordering.running(rows, ["l_returnflag"], order, {"total": F.col("l_quantity")}, {"least": F.col("l_extendedprice")}).select("l_orderkey", "l_linenumber", "l_returnflag", "total", "least")


@query("w11_quantile_normalise", """
WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id % 5 ORDER BY value, event_id) AS k, user_id % 5 AS s FROM events), m AS (SELECT k, sum(value::DECIMAL(38,10))::DOUBLE / count(value) AS v FROM r GROUP BY k) SELECT event_id, s, v AS normalised FROM r JOIN m USING (k)""")
def w11(spark, d):
    rows = load(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("s"), "value")
    return ranking.quantile_normalised(rows, "s", "event_id", "value").select("event_id", "s", "normalised")


@query("w12_ordered_dedup", """
SELECT stem, p_partkey, row_number() OVER (ORDER BY p_partkey) AS rank FROM (SELECT string_split(p_name, ' ')[1] AS stem, min(p_partkey) AS p_partkey FROM part GROUP BY 1)""")
def w12(spark, d):
    return ranking.first_distinct(load(spark, d, "part").select(F.split("p_name", " ")[0].alias("stem"), "p_partkey"), "stem", "p_partkey")


@query("w13_diversity_cap", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def w13(spark, d):
    rows = load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.diverse(rows, "l_suppkey", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)


@query("w16_most_advanced", "SELECT p_brand, max(p_size) AS stage, min(p_partkey) FILTER (WHERE p_size = m) AS p_partkey FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY 1")
def w16(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("stage"), F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("p_partkey"))


@query("u01_union_sources", "SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount FROM orders UNION ALL SELECT 'part', p_partkey, p_retailprice FROM part")
def u01(spark, d):
    a = load(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return a.unionByName(load(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_retailprice").alias("amount"), F.col("p_partkey").alias("id")))


@query("u03_union_distinct_ordered", """
WITH u AS (SELECT o_custkey AS k, o_orderkey AS ord FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 1000000 + o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') SELECT k, min(ord) AS ord, row_number() OVER (ORDER BY min(ord)) AS rank FROM u GROUP BY k""")
def u03(spark, d):
    o = load(spark, d, "orders")
    u = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord")).union(o.where("o_orderpriority LIKE '1%'").select("o_custkey", F.col("o_orderkey") + 1000000))
    return ranking.first_distinct(u, "k", "ord")


@query("u04_except_known", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000")
def u04(spark, d):
    known = load(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return load(spark, d, "lineitem").where("l_quantity > 49").select("l_suppkey").distinct().join(known, "l_suppkey", "left_anti")


@query("u05_weeks_in_common", """
SELECT a.l_suppkey, list_sort(list_intersect(a.w, b.w)) AS common FROM (SELECT l_suppkey, list(DISTINCT l_linenumber) AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT l_suppkey, list(DISTINCT l_linenumber) AS w FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40 GROUP BY 1) b USING (l_suppkey)""")
def u05(spark, d):
    per = lambda c, n: load(spark, d, "lineitem").where(c).groupBy("l_suppkey").agg(F.collect_set("l_linenumber").alias(n))
    return per("l_returnflag = 'R'", "a").join(per("l_returnflag = 'A' AND l_quantity > 40", "b"), "l_suppkey").select("l_suppkey", F.array_sort(F.array_intersect("a", "b")).alias("common"))


@query("u06_partition", "SELECT source, count(*) FILTER (WHERE n_chars >= 1000) AS solid, count(*) FILTER (WHERE n_chars < 1000) AS to_check FROM documents GROUP BY 1 ORDER BY count(*) DESC, source")
def u06(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") >= 1000).alias("solid"), F.count_if(F.col("n_chars") < 1000).alias("to_check")).orderBy(F.desc(F.col("solid") + F.col("to_check")), "source")


@query("u07_jaccard", """
WITH s AS (SELECT l_suppkey, list(DISTINCT l_partkey % 40) AS parts FROM lineitem GROUP BY 1) SELECT a.l_suppkey AS a, b.l_suppkey AS b, 1 - len(list_intersect(a.parts, b.parts)) / len(list_distinct(list_concat(a.parts, b.parts)))::DOUBLE AS distance FROM s a JOIN s b ON b.l_suppkey = a.l_suppkey + 1""")
def u07(spark, d):
    s = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey") % 40).alias("parts"))
    a, b = s.select(F.col("l_suppkey").alias("a"), F.col("parts").alias("x")), s.select(F.col("l_suppkey").alias("b"), F.col("parts").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", (1 - F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("distance"))
