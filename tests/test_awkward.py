"""Queries against their SQL on small tables of awkward rows."""

from __future__ import annotations

import math
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import place, plain, same

from tessera.functions import stats
from tessera.operators import aggregates, ranking
from tessera.plans import ORACLE_SQL, QUERIES


@pytest.fixture
def differing(spark, tmp_path):
    """Writes tables, given as rows and a schema each, and returns the rows in which a query and its SQL differ."""

    def of(name, **tables):
        c = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        rows = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=place)
        want = c.sql(ORACLE_SQL[name])
        order = [want.columns.index(x) for x in columns]
        expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=place)
        assert len(rows) == len(expected)
        return [(a, b) for a, b in zip(rows, expected) if not same(a, b)]

    return of


def test_a_keyword_ends_where_ascii_words_end(differing):
    texts = ["queen", "queenêqueen", "èqueeneuxqueen queens", "queen_2 Queen", "none", "", None, "queenß queené queen"]
    assert not differing("c09_keyword_in_context", documents=(list(enumerate(texts)), "doc_id long, text string"))


def test_every_text_that_is_not_blank_has_a_vector_of_unit_length(differing):
    words = [f"w{i}" for i in range(200)]
    places = {}
    for w in words:
        h = zlib.crc32(w.encode())
        places.setdefault((h % 32, h >> 31), w)
    k = next(k for k in range(32) if (k, 0) in places and (k, 1) in places)
    cancels = f"{places[k, 0]} {places[k, 1]}"
    texts = [cancels, cancels.upper(), f"{cancels} {cancels}", "\n", "\t\r\n", " ", "\u00a0", " \u3000\u2003 ", "\u2028", "\u00a0\n", "", None, "a", "\u00a0a ", "\U0001f600"]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(3, "held"), (6, "\n")]
    assert not differing("v06_pending_embeddings", documents=(rows, "doc_id long, text string"))


def test_spaces_of_all_kinds_go_from_titles_and_abstracts(differing):
    texts = [" a ", "\u00a0a\u3000", "\u2003", "", None, "a\u00a0b", "\nb\n", "\u200bc"]
    rows = [(i, t, s) for i, (t, s) in enumerate((t, s) for t in texts for s in texts)]
    assert not differing("c33_title_and_abstract", documents=(rows, "doc_id long, text string, source string"))


def test_the_end_of_a_text_names_no_subjects(differing):
    texts = ["It was seen In", "patients with", "treatment of ", "in\n-", "x", "", None, "topic", "in-"]
    rows = [(8 * i + k, t) for i, t in enumerate(texts) for k in range(8)]
    assert not differing("f10_population_gate", documents=(rows, "doc_id long, text string"))


def test_keys_of_one_ordinal_have_their_ranks_by_key(spark):
    df = spark.createDataFrame([(k, o) for k in range(60) for o in (k // 20, 5)], "k long, ord long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ranking.first_distinct(df, "k", "ord").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["rank"], r.k, r.ord) for r in rows) == [(k + 1, k, k // 20) for k in range(60)]


def test_drugs_of_equal_means_rank_by_drug_whatever_the_order_of_their_rows(spark, tmp_path):
    rows = [(1, 0.3), (2, 0.1), (1, 0.2), (2, 0.2), (1, 0.1), (2, 0.3), (4, 0.5), (4, None)]  # 0.1 + 0.2 + 0.3 > 0.3 + 0.2 + 0.1 as doubles
    spark.createDataFrame([(s, 20, x, 1.0) for s, x in rows], "l_suppkey long, l_partkey long, l_discount double, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, 100.0, 3) for s in (1, 2, 4)], "s_suppkey long, s_acctbal double, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["g21_reverse_screen"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.drug for r in got] == [4, 1, 2] and got[1].score == got[2].score


def test_a_mean_is_exact_where_decimals_hold_its_values(spark):
    cases = {1: [0.1, 0.2, 0.3, None], 2: [0.3, 0.2, 0.1], 3: [1e30, 2e30], 4: [1.0, float("nan")], 5: [float("inf"), 1.0], 6: [None], 7: [1e-30], 8: [-5.5, 5.5], 9: [1e10, 9.9e9]}
    df = spark.createDataFrame([(k, x) for k, xs in cases.items() for x in xs], "k int, x double").coalesce(1)
    got = {r.k: r.m for r in df.groupBy("k").agg(stats.exact_mean("x").alias("m")).collect()}
    assert got[1] == got[2] == 0.2 and math.isclose(got[3], 1.5e30) and math.isnan(got[4]) and got[5] == float("inf")
    assert got[6] is None and got[7] == 1e-30 and got[8] == 0 and got[9] == 9.95e9


def test_a_probe_without_a_mean_or_a_name_is_no_gene_s_best(differing):
    rows = [(1, 7, None), (1, 8, None), (2, None, 9.0), (2, 5, 3.0), (3, None, 1.0), (4, 6, None), (4, 2, 1.5), (5, 3, float("nan")), (5, 4, 2.0)]
    assert not differing("a16_probe_to_gene", lineitem=(rows, "l_partkey long, l_suppkey long, l_extendedprice double"))


def test_of_probes_with_equal_means_the_first_stands_for_its_gene(spark, tmp_path):
    rows = [(1, 3, x) for x in (0.3, 0.2, 0.1)] + [(1, 4, x) for x in (0.1, 0.2, 0.3)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in QUERIES["a16_probe_to_gene"](spark, str(tmp_path)).collect()] == [(1, 3, 0.2)]


_LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"


def _lines(*suppliers, order=lambda i: i, number=lambda i: 1 + i % 7):
    """A line of one part for each supplier; no two have one ordinal."""
    return [(order(i), 12, s, number(i), 50.0, "ANR"[i % 3], "FO"[i % 2]) for i, s in enumerate(suppliers)], _LINES


@pytest.mark.parametrize(
    "lines",
    [
        _lines(3, None, 4, 3, None, 1),
        _lines(None, None),
        _lines(3, 4, 3, 1, 5, order=lambda i: None if i in (0, 1) else i),
        _lines(3, 4, 3, 1, 5, number=lambda i: None if i in (0, 1) else 1 + i),
        _lines(3, -3, -4, 4, -8, None, 0, -1),
    ],
    ids=["no supplier", "no supplier at all", "no order", "no line number", "suppliers below zero"],
)
def test_an_agent_s_sponsors_where_keys_are_missing_or_below_zero(differing, lines):
    assert not differing("a08_agent_record", lineitem=lines)


def test_an_agent_s_sponsors_of_one_ordinal_go_by_name(spark, tmp_path):
    rows = [(1, 12, s, 1, 50.0, "A", "F") for s in (7, 2, 5, 4, 2)] + [(0, 12, 1, 1, 50.0, "A", "F")]
    for n, some in enumerate((rows, rows[::-1])):
        spark.createDataFrame(some, _LINES).coalesce(1).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        (row,) = QUERIES["a08_agent_record"](spark, f"{tmp_path}/{n}").collect()
        assert row.sponsors == ["SP 1", "SP 5", "SP 7", "Sp 2, Inc.", "Sp 4, Inc."]


def test_an_agent_s_records_without_a_sponsor_name_none(spark):
    records = [("a", "S", "S", None, None, ["oral"], s, o, True) for s, o in (("Pfizer", 2), (None, 1), ("PFIZER, Inc.", None), ("Incyte", None), ("Lilly", 3))]
    df = spark.createDataFrame(records, "agent string, study_id string, source_id string, status string, stage string, routes array<string>, sponsor string, ordinal long, has_results boolean")
    assert aggregates.agent_summary(df).first().sponsors == ["Pfizer", "Lilly", "Incyte"]
