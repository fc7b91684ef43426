import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sigmill import runtime
from sigmill.functions import stats
from sigmill.functions.exact import INVALID, TOO_LARGE, _long, canonical, fisher_table, fisher_two_sided, with_fisher
from sigmill.operators import metrics, multiplicity, ranking, revalidate
from sigmill.operators.multiplicity import benjamini_hochberg

ABCD = "a long, b long, c long, d long"


def scored(spark, *tables):
    rows = stats.with_statistics(spark.createDataFrame(list(tables), ABCD)).collect()
    return {(r.a, r.b, r.c, r.d): r for r in rows}


def test_golden_ratios(spark):
    golden = {
        (50, 950, 4950, 994050): (10.090909090909092, 7.690971775220735, 13.239737351405022, 10.569377990430622, 7.942368465883525, 14.065294450195502),
        (0, 100, 50, 99850): (9.793255563180081, 0.6083777879352199, 157.64522707388826, 9.837003103295404, 0.6027792775366385, 160.5341020509148),
        (1, 1, 1, 0): (2 / 3, 0.16673176883993762, 2.6656254386115865, 1 / 3, 0.006614174656049977, 16.798938172804046),
    }
    rows = scored(spark, *golden)
    for table, values in golden.items():
        r = rows[table]
        assert (r.prr, r.prr_low, r.prr_high, r.ror, r.ror_low, r.ror_high) == pytest.approx(values, rel=2e-13)
    assert rows[50, 950, 4950, 994050].chi2 == pytest.approx(398.43863964466982, rel=2e-14)


def test_labels_scores_and_points(spark):
    rows = scored(spark, (20, 80, 40, 860), (5, 95, 5, 895), (10, 90, 100, 800), (2, 1, 1, 100), (0, 0, 0, 0), (2**51, 2**51, 2**51, 2**51))
    assert rows[20, 80, 40, 860].prr == pytest.approx(4.5) and rows[20, 80, 40, 860].ror == pytest.approx(5.375)
    assert rows[20, 80, 40, 860].chi2 == pytest.approx(35.9042553191) and rows[20, 80, 40, 860].outcome == stats.MEETS
    assert rows[5, 95, 5, 895].prr == pytest.approx(9.0) and rows[10, 90, 100, 800].outcome == stats.BELOW
    assert rows[2, 1, 1, 100].outcome == stats.BELOW and rows[10, 90, 100, 800].score < 0
    assert rows[0, 0, 0, 0].chi2 == 0 and rows[2**51, 2**51, 2**51, 2**51].chi2 == 0
    points = ranking.map_coordinates(stats.with_statistics(spark.createDataFrame([(20, 80, 40, 860)], ABCD))).first()
    assert points.map_x == pytest.approx(math.log2(4.5)) and points.map_y == pytest.approx(math.log10(20))


@settings(max_examples=60, deadline=None)
@given(st.tuples(*[st.integers(1, 10**6)] * 4))
def test_swapping_rows_inverts_the_ratios(table):
    a, b, c, d = table
    prr = (a / (a + b)) / (c / (c + d))
    assert prr * ((c / (c + d)) / (a / (a + b))) == pytest.approx(1)
    p, _ = fisher_two_sided(np.array([(a % 50, b % 50, c % 50, d % 50), (c % 50, d % 50, a % 50, b % 50)]))
    assert p[0] == p[1]


def brute(a, b, c, d):
    r1, c1, n = a + b, a + c, a + b + c + d
    each = [math.comb(c1, x) * math.comb(n - c1, r1 - x) for x in range(max(0, r1 + c1 - n), min(r1, c1) + 1)]
    seen = math.comb(c1, a) * math.comb(n - c1, r1 - a)
    return sum(x for x in each if x <= seen * (1 + 1e-7)) / math.comb(n, r1)


def test_exact_test_against_all_small_tables():
    tables = np.array(list(itertools.product(range(7), repeat=4)))
    p, status = fisher_two_sided(tables)
    assert set(status) == {"ok"}
    assert max(abs(x - brute(*map(int, t))) for x, t in zip(p, tables)) < 1e-10


def test_exact_test_goldens_and_bounds():
    golden = {
        (1, 9, 11, 3): 0.0027594561852200836,
        (123, 456, 789, 1011): 2.0292871311477705e-23,
        (10000, 20000, 30000, 40000): 6.926875748277738e-177,
        (5, 995, 1000, 999998000): 8.367807727781138e-18,
        (17, 0, 3, 99): 6.9933612949115424e-18,
        (0, 100, 50, 99850): 1.0,
        (999999, 1000001, 1000001, 999999): 0.99920211558880045,
    }
    p, _ = fisher_two_sided(np.array(list(golden)))
    assert p == pytest.approx(list(golden.values()), rel=2e-6)
    p, status = fisher_two_sided(np.array([(800000, 1200000, 1200000, 800000), (-1, 2, 3, 4), (2**53, 1, 1, 1)]))
    assert status == [TOO_LARGE, INVALID, INVALID] and np.isnan(p).all()
    layouts = [(3, 7, 11, 2), (7, 3, 2, 11), (11, 2, 3, 7), (2, 11, 7, 3), (3, 11, 7, 2), (11, 3, 2, 7), (7, 2, 3, 11), (2, 7, 11, 3)]
    assert len(set(fisher_two_sided(np.array(layouts))[0].tolist())) == 1


def test_exact_test_in_spark(spark):
    rows = [(1, 9, 11, 3), (1, 9, 11, 3), (None, 1, 1, 1), (0, 0, 0, 0)]
    got = with_fisher(spark.createDataFrame(rows, ABCD)).collect()
    assert sorted((r.fisher_status, r.fisher_p is None) for r in got) == [("invalid", True), ("ok", False), ("ok", False), ("ok", False)]
    assert fisher_table(spark.createDataFrame([], ABCD)).count() == 0
    tail = spark.createDataFrame([(398.43863964466982,), (0.0,), (None,), (35.9042553191,)], "chi2 double").select("chi2", stats.chi2_upper_tail(F.col("chi2")).alias("chi2_p")).collect()
    assert tail[0].chi2_p == pytest.approx(1.2045499525976615e-88, rel=1e-12) and tail[1].chi2_p == 1 and tail[2].chi2_p is None
    assert tail[3].chi2_p == pytest.approx(2.0725557423e-09, rel=1e-8)


def test_long_and_short_ways_agree():
    rng = np.random.default_rng(3)
    tables = canonical(rng.integers(1, 60, (200, 4)) * rng.integers(1, 40, (200, 1)))
    short, _ = fisher_two_sided(tables)
    for t, p in zip(tables.tolist(), short):
        value, status = _long(*t)
        assert status == "ok" and value == pytest.approx(p, rel=1e-9, abs=1e-300)
    assert _long(250_000, 250_000, 250_000, 250_000) == (1.0, "ok") and _long(5000, 0, 0, 5000)[0] < 1e-300


def test_a_table_gets_the_same_bits_in_any_batch():
    rng = np.random.default_rng(8)
    tables = rng.integers(0, 12, (400, 4)) * rng.integers(1, 90, (400, 1))
    together, _ = fisher_two_sided(tables)
    assert [fisher_two_sided(t)[0][0] for t in tables] == together.tolist()


def test_chi_square_tail_against_the_error_function(spark):
    values = [10 ** (e / 10) for e in range(-120, 30)] + [2 * 0.46875**2, 32.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", stats.chi2_upper_tail(F.col("x")).alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(math.sqrt(r.x / 2)), rel=1e-12, abs=1e-300) for r in rows)


def test_exact_test_of_a_hot_table(spark, monkeypatch):
    rows = [(1, 9, 11, 3, n) for n in range(400)] + [(n, 2, 3, 4, n) for n in range(400)]
    cells = spark.createDataFrame(rows, f"{ABCD}, k long")
    want = sorted(map(tuple, with_fisher(cells).collect()))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, with_fisher(cells).collect())) == want and len(want) == 800


def q_values(spark, ps):
    rows = spark.createDataFrame([("d", "x", "s", "r", f"e{n:03}", p) for n, p in enumerate(ps)], "dataset_id string, drug_text string, drug_text_source string, drug_role string, event_pt string, fisher_p double")
    return [r.fdr_q for r in benjamini_hochberg(rows).orderBy("event_pt").collect()]


def test_false_discovery_rate(spark):
    assert q_values(spark, [0.01, 0.04, 0.5]) == pytest.approx([0.03, 0.06, 0.5])
    assert q_values(spark, [0.01, 0.04, 0.01]) == pytest.approx([0.015, 0.04, 0.015])
    assert q_values(spark, [0.01, 0.04, 0.01, 0.5]) == pytest.approx([0.02, 0.04 * 4 / 3, 0.02, 0.5])
    assert q_values(spark, [0.01, None, 0.5]) == pytest.approx([0.02, None, 0.5])
    assert q_values(spark, []) == []


@pytest.mark.parametrize("most, rows_per_task", [(runtime.BROADCAST_BYTES, multiplicity.ROWS_PER_TASK), (runtime.BROADCAST_BYTES, 50), (0, 50)])
def test_false_discovery_rate_of_a_hot_family(spark, monkeypatch, most, rows_per_task):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", most)
    monkeypatch.setattr(multiplicity, "ROWS_PER_TASK", rows_per_task)
    random = np.random.default_rng(3)
    ps = [*10 ** random.uniform(-12, 0, 300), *[1.0] * 200, *[0.0] * 5, *[0.25] * 40, *[None] * 30, float("nan")]
    rows = [("d", "hot", None, "r", n, None if p is None else float(p)) for n, p in enumerate(ps)]
    rows += [("d", "hot", "None", "r", 0, 0.2), ("d", "hot", "", "r", 0, 0.3), (None, None, None, None, 0, 0.4), (None, None, None, None, 1, 0.4)]
    tests = spark.createDataFrame(rows, "dataset_id string, drug_text string, drug_text_source string, drug_role string, n long, fisher_p double")
    found = {tuple(r)[:5]: r.fdr_q for r in benjamini_hochberg(tests).collect()}
    ranked = sorted((p for p in ps if p is not None), key=lambda p: (p != p, p))
    q, least = {}, 1.0
    for rank in range(len(ranked), 0, -1):
        p = ranked[rank - 1]
        least = min(least, p * len(ranked) / rank) if p == p else least
        q.setdefault(str(p), least)
    assert len(found) == len(rows)
    for key, p in ((r[:5], r[5]) for r in rows[: len(ps)]):
        assert found[key] == (None if p is None else pytest.approx(q[str(p)], rel=1e-12))
    assert [found[r[:5]] for r in rows[len(ps) :]] == pytest.approx([0.2, 0.3, 0.4, 0.4])


def test_pages_and_forest(spark):
    rows = spark.createDataFrame([(f"e{n:03}", float(n % 7) if n else None, 0.1 if n % 5 else 0.0, 9.0, "g") for n in range(120)], "event_pt string, prr double, prr_low double, prr_high double, g string")
    everything = sorted(((r.prr if r.prr is not None else -1), r.event_pt) for r in rows.collect())
    first = ranking.page(rows, 1).orderBy("place").collect()
    assert len(first) == 50 and first[0].prr == 6.0 and [r.event_pt for r in first][:3] == ["e006", "e013", "e020"]
    last = ranking.page(rows, 99).orderBy("place").collect()
    assert [r.place for r in last] == list(range(101, 121)) and last[-1].event_pt == "e000" and everything[0][1] == "e000"
    drawn = ranking.forest_points(ranking.page(rows, 1, ("g",)), ("g",)).groupBy("plot").count().collect()
    counts = {r.plot: r["count"] for r in drawn}
    assert counts["shown"] == 30 and sum(counts.values()) == 50


def test_metrics_and_flags(spark):
    base = stats.with_statistics(spark.createDataFrame([(20, 80, 40, 860), (0, 1, 2, 3)], ABCD)).selectExpr("*", "cast(null as double) as fisher_p", "cast(null as double) as fdr_q")
    rows = metrics.metrics_long(metrics.with_metrics(base), ("a",)).orderBy("a", "method").collect()
    assert [(r.a, r.method) for r in rows] == [(0, "prr"), (0, "ror"), (20, "prr"), (20, "ror")]
    assert rows[0].correction_applied and rows[0].added_to_each_cell == 0.5 and rows[2].input_cells == "observed" and rows[2].p_value is None
    assert metrics.review_flags(base).where("a = 20").first().reason == "a=20; PRR=4.500000; Yates chi-square=35.904255"


def test_revalidation(spark):
    base = stats.with_statistics(spark.createDataFrame([("x", 20, 80, 40, 860), (None, 5, 95, 5, 895)], f"k string, {ABCD}"))
    assert revalidate.mismatches(base, base, ("k",)).count() == 0
    changed = base.selectExpr("k", "prr * (1 + 1e-9) as prr", "ror", "outcome")
    assert {(r.k, r.field) for r in revalidate.mismatches(changed, base, ("k",)).collect()} == {("x", "prr"), (None, "prr")}
    assert [r.field for r in revalidate.mismatches(base.where("k = 'x'"), base, ("k",)).collect()] == ["row"]
