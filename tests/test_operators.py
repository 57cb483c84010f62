"""Operators on tiny frames: rules that the driver tables do not reach."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import labels, passages, stats, text, udfs
from tessera.operators import aggregates, evidence, graph, ingestion, joins, ledger, ranking, search, statistics
from tessera.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_entity_key_is_idempotent_after_the_cut(spark):
    long = "A" * 119 + " b"
    key = one(spark, text.entity_key(F.lit(long)))
    assert key == "a" * 119 and one(spark, text.entity_key(F.lit(key))) == key
    assert one(spark, text.entity_key(F.lit(" -- "))) == "unknown"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_entity_keys_have_their_shape(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string").select(text.entity_key(F.col("n")).alias("k"))
    again = df.select("k", text.entity_key(F.col("k")).alias("k2")).collect()
    assert all(r.k == r.k2 and len(r.k) <= 120 and r.k for r in again)


def test_stages(spark):
    a = lambda *p: one(spark, text.trial_stage(F.array(*[F.lit(x) for x in p])))
    assert a("PHASE2", "PHASE3") == "PHASE_2_3" and a("PHASE1", "PHASE2") == "PHASE_1_2"
    assert a("EARLY_PHASE1") == "EARLY_PHASE_1" and a("PHASE4", "PHASE3") == "PHASE_4"
    assert one(spark, text.stage_rank(F.lit("approval"))) == 8 and one(spark, text.stage_rank(F.lit(None).cast("string"))) == 0


def test_endpoints_and_weeks(spark):
    e = lambda t, c=None: one(spark, text.endpoint(F.lit(t), F.lit(c).cast("string")))
    assert e("Achieving F-VASI75 at Week 24")[:] == ("F-VASI", 75, "face")
    assert e("T-VASI", "T-VASI50")[1] == 50 and e("F-VASI25/50/75") is None
    assert e("Mean VNS score") is None and e("VNS responders (genital)")[2] == "genital"
    w = lambda *x: one(spark, text.week(*[F.lit(v).cast("string") for v in x]))
    assert tuple(w("Week 12", "Week 24", None)) == (12, "row_label")
    assert tuple(w(None, "Weeks 4, 8 and 12", "Week 24")) == (None, None)
    assert tuple(w(None, "Response", "up to Week 48")) == (None, None)


def test_printed_cells(spark):
    c = lambda a, h="": one(spark, text.printed_cell(F.lit(a), F.lit(h)))
    assert tuple(c("17/33 (51.5)")) == (17, 33, 51.5) and tuple(c("(n = 38) 14 (36.8%)")) == (14, 38, 36.8)
    assert tuple(c("4 (8.2%)", "Cream (n = 49)")) == (4, 49, 8.2) and c("n/a") is None


def test_bounds_are_null_where_the_record_supports_none(spark):
    b = lambda *x: one(spark, stats.bounds(*[F.lit(v).cast("int") for v in x]))
    assert tuple(b(10, 20, 40)) == (50.0, 25.0, 75.0, 50.0, False)
    assert b(None, 20, 40) is None and b(21, 20, 40) is None and b(10, 20, 15) is None and b(0, 0, 4) is None


def test_lgamma(spark):
    for x in (0.5, 1.0, 3.7, 120.0):
        assert one(spark, stats.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-11)


def test_population_classifier_prefers_the_denominator(spark):
    p = lambda t: one(spark, text.analysis_population(F.lit(t)))
    assert p("non-responder imputation; only participants with available data") == "as_observed"
    assert p("a subset of participants") == "subgroup" and p(" ") is None


def test_arms(spark):
    def arm(label, agents=(), trial_agents=(), trial_routes=()):
        lists = [F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in (agents, trial_agents, trial_routes)]
        return one(spark, labels.arm(F.lit(label).cast("string"), *lists))

    a = arm("Upa 6 mg Period 1, Then Upa 6 mg Period 2", ["upa"])
    assert a["role"] == "active" and a["dose_value"] == 6
    a = arm("Vehicle to Ruxo 1.5% BID", ["ruxo"], [], ["topical"])
    assert a["role"] == "sequence" and a["flags"] == ["treatment_changes_within_arm", "route_inferred_from_trial"]
    a = arm("Rit 200 mg - 50 mg QD", ["rit"])
    assert (a["loading_dose_value"], a["dose_value"], a["frequency"]) == (200, 50, "QD")
    assert arm("Placebo", [], ["x"])["role"] == "placebo" and arm(None) is None
    a = arm("Double-Blind Period: Ruxo cream twice daily + NB-UVB", [], ["ruxo"])
    assert (a["period"], a["agent"], a["route"], a["phototherapy"], a["dose_value"]) == ("Double-Blind Period", "ruxo", "topical", True, None)
    assert a["flags"] == ["agent_inferred_from_trial"]
    assert arm("A 5 mg and B 10 mg", ["a", "b"])["flags"] == ["treatment_changes_within_arm", "multiple_agents_in_arm"]


def test_numbers():
    assert udfs.numbers("3.93+/-0.59 in one hundred and five of 4,000; forty-two") == [3.93, 0.59, 4000.0, 105.0, 42.0]
    assert udfs.numbers(None) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["A sentence here. ", "word ", "\n\n", "\n \n\n", "## Part\n", "x" * 400, "End! "]), max_size=40))
def test_passages_lie_within_the_text(parts):
    t = "".join(parts)
    found = passages.passages(t, 120, 30, 10)
    assert all(t[p.start : p.end] == t[p.start : p.end].strip() and p.end > p.start for p in found)
    assert bool(found) == bool(t.strip()) or all(line.startswith("##") or not line.strip() for line in t.splitlines())


def test_window_starts_end_flush():
    assert passages.window_starts(300) == [0] and passages.window_starts(1000)[-1] == 490


def test_best_row_breaks_ties_by_order(spark):
    df = spark.createDataFrame([("a", 5, 2), ("a", 5, 1), ("b", 1, 3)], "k string, n int, o int")
    assert {(r.k, r.o) for r in ranking.best_per_key(df, ["k"], [F.desc("n"), F.col("o")]).collect()} == {("a", 1), ("b", 3)}


def test_auroc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0), (1, 2.0), (0, 0.0)], "y int, s double")
    assert aggregates.auroc(df, [], "y", "s").first().auroc == pytest.approx(0.875)


def test_edges_merge_to_observed_and_stronger(spark):
    rows = [("a", "p", "b", 0.3, "asserted", None, "x", "e1", 1), ("a", "p", "b", 0.2, "observed", "association", "y", "e2", 2), ("a", "p", "b", 0.1, "observed", "perturbation_in_human", "z", "e1", 3)]
    e = graph.merge_edges(spark.createDataFrame(rows, "subject string, predicate string, object string, confidence double, claim string, causal_level string, extraction_method string, evidence string, ordinal int")).first()
    assert (e.confidence, e.claim, e.causal_level, e.extraction_method, e.evidence) == (0.3, "observed", "perturbation_in_human", "x", ["e1", "e2"])


def test_components_of_a_long_path(spark):
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in graph.components(path).collect()} == {0}


def test_links_within_one_source_do_not_connect(spark):
    rec = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, source string")
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    got = {r.id: r.representative for r in graph.linked_records(rec, links, F.col("source")).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_tolerance_join_has_no_gap_at_cell_edges(spark):
    l = spark.createDataFrame([(1, 0.99), (1, 5.0)], "k int, x double")
    r = spark.createDataFrame([(1, 1.98), (1, 3.9)], "k int, y double")
    assert [row.x for row in joins.within_tolerance(l, r, "x", "y", 1.0, ["k"]).collect()] == [5.0]


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, f string")
    assert joins.null_safe(a, a.select("k", "f"), ["k", "f"], "left_semi").count() == 2


def test_held_keys_block_and_nulls_do_not(spark):
    items = spark.createDataFrame([(1, "d1", "t1"), (2, None, "t2"), (3, None, "t2"), (4, "d9", "t4")], "o int, doi string, title string")
    held = {"doi": spark.createDataFrame([("d9",)], "doi string"), "title": spark.createDataFrame([("tx",)], "title string")}
    assert sorted(r.o for r in ingestion.not_held(items, held, "o").collect()) == [1, 2]


def test_relevant_trials(spark):
    none = []
    rows = [
        (1, "Cream trial", None, "about nothing", none, none, ["PHASE1"], False, "2020-01-01"),
        (2, "Inactive vehicle", None, "uses cream", none, none, ["PHASE3"], True, "2021-01-01"),
        (3, "Creams in adults", None, "", none, none, ["PHASE2"], False, "2022-01-01"),
    ]
    df = spark.createDataFrame(rows, "id long, brief_title string, official_title string, summary string, conditions array<string>, keywords array<string>, phases array<string>, has_results boolean, last_update_date string")
    df = df.withColumn("interventions", F.array().cast("array<struct<name:string,description:string,other_names:array<string>>>"))
    assert [r.id for r in search.relevant_trials(df, "active cream").collect()] == [3, 2]
    assert [r.id for r in search.relevant_trials(df.where("id = 1"), "cream").collect()] == [1]  # the filter would leave nothing


def test_filters_take_terms_literally(spark):
    df = spark.createDataFrame([("100% cream",), ("100 cream",)], "brief_title string")
    assert df.where(search.contains_any(["brief_title"], "100%")).count() == 1


def test_seal():
    s = ledger.sealed({"b": 1, "a": [1, 2]})
    assert ledger.verify_seal(s) and not ledger.verify_seal(s | {"b": 2})


def test_conflicts(spark):
    df = spark.createDataFrame([(1, "u"), (2, "u")], "t int, unit_key string")
    assert [(r.rule, r.value, r.n) for r in ledger.conflicts(df, ["t", "unit_key"]).collect()] == [("unit_key", "u", 2)]


def test_e_values():
    import numpy as np

    null = statistics.null_loglik(np.array(30.0), 50.0, np.array(10.0), 50.0)
    pooled = statistics.loglik(np.array(40.0), 100.0, np.array(0.4))
    assert float(null) == pytest.approx(float(pooled), abs=1e-6)  # on the boundary both rates are the pooled one
    draws = np.linspace(0.5, 0.7, 50)
    assert statistics.power(draws, draws - 0.3, 200, 200, 0.1) > 0.9
    assert statistics.power(draws - 0.3, draws, 200, 200, 0.1) == 0.0


def test_null_by_grid():
    """The boundary's maximum against a fine grid, for margins and ratios."""
    import numpy as np

    for ra, na, rc, nc, margin, ratio in ((30, 50, 10, 50, 0.0, 1.0), (45, 50, 5, 40, 0.1, 1.0), (20, 30, 3, 30, 0.0, 1.5), (9, 10, 1, 10, -0.1, 0.8), (10, 10, 0, 10, 0.05, 1.0)):
        c = np.linspace(1e-7, 1 - 1e-7, 2_000_001)
        a = ratio * c + margin
        c, a = c[(a > 0) & (a < 1)], a[(a > 0) & (a < 1)]
        grid = (statistics.loglik(ra, na, a) + statistics.loglik(rc, nc, c)).max()
        assert float(statistics.null_loglik(np.array(float(ra)), float(na), np.array(float(rc)), float(nc), margin, ratio)) == pytest.approx(grid, abs=1e-6)
    assert float(statistics.null_loglik(np.array(5.0), 50.0, np.array(10.0), 50.0)) == pytest.approx(float(statistics.loglik(5.0, 50.0, 0.1) + statistics.loglik(10.0, 50.0, 0.2)))


def test_power_by_simulation():
    import numpy as np

    rng = np.random.default_rng(1)
    a, c = rng.beta(30, 30, 40), rng.beta(20, 40, 40)
    pick = rng.integers(0, 40, 4000)
    ra, rc = rng.binomial(60, a[pick]).astype(float), rng.binomial(50, c[pick]).astype(float)
    better = a > c
    terms = statistics.loglik(ra[:, None], 60.0, a[better][None]) + statistics.loglik(rc[:, None], 50.0, c[better][None])
    log_e = np.log(np.exp(terms - terms.max(axis=1, keepdims=True)).mean(axis=1)) + terms.max(axis=1) - statistics.null_loglik(ra, 60.0, rc, 50.0)
    assert statistics.power(a, c, 60, 50, 0.1) == pytest.approx((log_e >= -np.log(0.1)).mean(), abs=0.03)


def test_special_functions():
    assert statistics.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-7)
    assert statistics.trigamma(statistics.inverse_trigamma(0.37)) == pytest.approx(0.37)


def test_rate_limiter_does_not_count_rejections():
    ok, recent = events.limited([0, 1, 2, 61, 62], [], 2, 60)
    assert ok == [True, True, False, True, True] and recent == [61, 62]


def test_stream_windows(spark, tmp_path):
    rows = spark.range(6).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 1800).alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(str(tmp_path / "in"))
    source = events.stream(spark, str(tmp_path / "in"))
    q = events.tumbling(source).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("w").collect()) == 6
    q = events.rate_limited_stream(source, 1, 3600.0).writeStream.outputMode("append").format("memory").queryName("l").start()
    q.processAllAvailable()
    q.stop()
    streamed = {(r.event_id, r.allowed) for r in spark.table("l").collect()}
    batch = {(r.event_id, r.allowed) for r in events.rate_limited(spark.read.parquet(str(tmp_path / "in")), 1, 3600.0).collect()}
    assert streamed == batch and len(batch) == 6


def test_reported_rows_carry_their_own_control(spark):
    cols = "source_id string, arm_label string, endpoint string, assessor string, agent string, dose_value double, n_analyzed int, percent double, arm_role string, week int, outcome_type string, ordinal int"
    rows = [("t1", "a", "F75", None, "rux", 1.5, 200, 30.0, "active", 24, "PRIMARY", 1), ("t1", "c", "F75", None, None, None, 100, 8.0, "placebo", 24, "PRIMARY", 2), ("t2", "a", "F75", None, "rux", 1.5, 150, 31.0, "active", 24, "PRIMARY", 3)]
    r = evidence.reported_with_comparator(spark.createDataFrame(rows, cols)).first()
    assert (r.source_id, r.difference, [o.source_id for o in r.others]) == ("t1", 22.0, ["t2"])


def test_rate_limiter_by_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.randrange(400)) for i in range(600)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    want = {}
    for user in {r[0] for r in rows}:
        passed = []
        for t, e in sorted((t, e) for u, e, t in rows if u == user):
            want[e] = sum(t - p < 20 for p in passed) < 2
            passed += [t] * want[e]
    assert {r.event_id: r.allowed for r in events.rate_limited(df, 2, 20.0).collect()} == want


def test_tail_shape_and_bootstrap(spark):
    import numpy as np

    u = (np.arange(20000) + 0.5) / 20000
    for k in (-0.3, 0.2, 0.5):
        assert statistics.pareto_k(((1 - u) ** -k - 1) / k, 0.2) == pytest.approx(k, abs=0.05)
    rng = np.random.default_rng(2)
    rows = [(c, float(v)) for c in range(60) for v in rng.normal(rng.normal(10, 2), 1, 5)]
    means = np.array([np.mean([v for x, v in rows if x == c]) for c in range(60)])
    r = statistics.bootstrap_by_cluster(spark.createDataFrame(rows, "c int, v double"), "c", "v", 400).first()
    error = means.std(ddof=1) / 60**0.5
    assert r["mean"] == pytest.approx(means.mean(), abs=0.3 * error) and (r.hi - r.lo) / 3.92 == pytest.approx(error, rel=0.25)


def test_moderated_by_its_equations(spark):
    """The fitted prior against the two moment equations, with derivatives of the log-gamma function taken numerically."""
    import numpy as np

    rng = np.random.default_rng(5)
    df, d0, s0 = 8, 6.0, 0.7
    s2 = s0 * d0 / rng.chisquare(d0, 4000) * rng.chisquare(df, 4000) / df
    rows = spark.createDataFrame([(float(c), float(s)) for c, s in zip(rng.normal(0, 1, 4000), s2)], "coef double, s2 double")
    got = statistics.moderated(rows, "coef", "s2", df, 0.5).toPandas()
    first = lambda x, h=1e-5: (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)
    second = lambda x, h=1e-3: (math.lgamma(x + h) - 2 * math.lgamma(x) + math.lgamma(x - h)) / h**2
    e = np.log(got.s2) - first(df / 2) + math.log(df / 2)
    post = (got.coef / (got.t * 0.5)) ** 2  # (d0 s0 + df s2) / (d0 + df)
    slope, level = np.polyfit(got.s2, post, 1)
    fitted = df / slope - df
    assert second(fitted / 2) == pytest.approx(e.var(ddof=1) - second(df / 2), rel=1e-3)
    assert level * (fitted + df) / fitted == pytest.approx(math.exp(e.mean() + first(fitted / 2) - math.log(fitted / 2)), rel=1e-3)
    assert fitted == pytest.approx(d0, rel=0.3)
    t, p = got.t.iloc[0], got.p.iloc[0]
    grid = np.linspace(-abs(t), abs(t), 20001)
    nu = fitted + df
    density = np.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi) * (1 + grid**2 / nu) ** (-(nu + 1) / 2)
    assert p == pytest.approx(1 - np.trapezoid(density, grid), abs=1e-3)


def test_passages_by_brute_force():
    """Units as paragraphs or cuts, joined while they fit, from the definition."""
    import re

    rng = __import__("random").Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["Word", "longer words here", ". Next", "! (Then", "\n\n", " \n \n", " ", "xyz"]) + rng.choice(["", " "]) for _ in range(rng.randrange(60)))
        target, overlap, least = 60, 15, 8
        expected = []
        pieces = []
        for m in re.finditer(r"(?s)(.+?)(?:\n\s*\n|$)", text):
            a, b = m.start(1) + len(m[1]) - len(m[1].lstrip()), m.end(1) - (len(m[1]) - len(m[1].rstrip()))
            while b - a > target:
                ends = [x.start() for x in re.finditer(r"(?<=[.!?])\s+(?=[A-Z0-9(\[])", text) if a < x.start() < a + target]
                cut = max(ends, default=a + target)
                pieces.append((a, cut))
                a = cut + len(text[cut:b]) - len(text[cut:b].lstrip())
            if a < b:
                pieces.append((a, b))
        begin = last = None
        for a, b in pieces:
            if begin is not None and b - begin > target:
                expected.append((begin, last))
                words = [x.start() for x in re.finditer(r"\S+", text) if max(begin, last - overlap) < x.start() < last]
                begin = words[0] if words else a
            begin, last = a if begin is None else begin, b
        if begin is not None:
            expected.append((begin, last))
        expected = [(a + len(text[a:b]) - len(text[a:b].lstrip()), b - (len(text[a:b]) - len(text[a:b].rstrip()))) for a, b in expected]
        kept = [x for x in expected if x[1] - x[0] >= least] or expected[:1]
        assert [(p.start, p.end) for p in passages.passages(text, target, overlap, least)] == kept


def test_combinations_take_each_name_twice(spark):
    from tessera.operators import links

    left = spark.createDataFrame([(i, f"l{i}", "jak", 1.0 - i / 100) for i in range(12)], "drug long, name string, class string, score double")
    right = spark.createDataFrame([(100 + i, f"r{i}" if i else "l0", "jak" if i == 1 else "pde", 0.9 - i / 50) for i in range(12)], "drug long, name string, class string, score double")
    got = links.combinations(left, right, 5, 2).collect()
    pairs = sorted(((-(a.score + b.score) / 2, a.drug, b.drug, a.name, b.name) for a in left.collect()[:5] for b in right.collect()[:5] if a.name != b.name and a["class"] != b["class"]))
    used, want = {}, []
    for s, a, b, x, y in pairs:
        if used.get(("l", x), 0) < 2 and used.get(("r", y), 0) < 2:
            used["l", x], used["r", y] = used.get(("l", x), 0) + 1, used.get(("r", y), 0) + 1
            want.append((a, b))
    assert [(r.l_drug, r.r_drug) for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))
