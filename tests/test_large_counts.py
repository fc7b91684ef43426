"""Tables of any size are tested: no number of terms leaves a p, a q or a metric out."""

import math

import numpy as np
import pytest
from fixture_tables import CELLS
from pyspark.sql import functions as F

from sigmill.functions.exact import fisher_table, fisher_two_sided, with_fisher
from sigmill.operators.cells import COMPARATOR, DEDUPLICATION, EVENT_SCOPE
from sigmill.queries import core

ABCD = "a long, b long, c long, d long"
#: more than 100,000 terms are no likelier than these tables, and p is below one half
LARGE = [(800000, 1200000, 1200000, 800000), (999000, 1001000, 1001000, 999000), (250000, 750000, 251000, 751000), (300000, 400000, 301000, 399000)]


def whole(a, b, c, d):
    """p from all terms of the support, each from its neighbour, without any formula for a single one."""
    r1, c1, n = a + b, a + c, a + b + c + d
    low = max(0, r1 + c1 - n)
    x = np.arange(low, min(r1, c1), dtype=np.longdouble)
    logs = np.concatenate([[0], np.cumsum(np.log((c1 - x) * (r1 - x) / ((x + 1) * (n - r1 - c1 + x + 1))))])
    terms = np.exp(logs - logs.max())
    return float(terms[logs <= logs[a - low] + np.log1p(np.longdouble(1e-7))].sum() / terms.sum())


def test_exact_test_of_large_tables(spark):
    bounded, status = fisher_two_sided(np.array(LARGE))
    assert set(status) == {"batch_required"} and np.isnan(bounded).all()
    want = {t: pytest.approx(whole(*t), rel=1e-9, abs=1e-300) for t in LARGE}
    for test in (fisher_table, with_fisher):
        found = test(spark.createDataFrame(LARGE, ABCD)).collect()
        assert {(r.a, r.b, r.c, r.d): r.fisher_p for r in found} == want and {r.fisher_status for r in found} == {"ok"}


def test_exact_test_of_the_largest_tables():
    # they come close to a normal distribution, of which these are so many standard deviations
    far = {4.0: 2 * 10**6, 0.5: 250_000}
    tables = [(10**12 - gap, 10**12 + gap, 10**12 + gap, 10**12 - gap) for gap in far.values()]
    assert fisher_two_sided(np.array(tables))[1] == ["batch_required"] * 2
    p, status = fisher_two_sided(np.array([*tables, (2**51, 2**51 - 1, 1, 2**51)]), None)
    assert status == ["ok"] * 3 and p.tolist() == [*(pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4) for z in far), 0.0]


def folder(spark, place):
    """One family of the large tables and a small one, and the small tables of the other tests."""
    rows = [("large", "ASPIRIN", "PROD_AI", "all", f"E{n}", *t, t[0] + t[1], t[0] + t[2], sum(t)) for n, t in enumerate([*LARGE, (20, 80, 40, 860)])]
    rows += [("s", drug, "PROD_AI", role, event, a, b, c, d, drugs, events, 3) for (drug, role, event), (a, b, c, d, drugs, events) in CELLS.items()]
    names = "dataset_id string, drug_text string, drug_text_source string, drug_role string, event_pt string, a long, b long, c long, d long, drug_reports long, event_reports long, universe_reports long"
    constants = {"comparator": F.lit(COMPARATOR), "event_scope": F.lit(EVENT_SCOPE), "deduplication_policy": F.lit(DEDUPLICATION)}
    spark.createDataFrame(rows, names).withColumns(constants).write.parquet(f"{place}/disproportionality_cells.parquet")
    return str(place)


def family_q():
    p = [*map(lambda t: whole(*t), LARGE), whole(20, 80, 40, 860)]
    q, least = {}, 1.0
    for rank, n in reversed(list(enumerate(np.argsort(p), 1))):
        least = q[f"E{n}"] = min(least, p[n] * len(p) / rank)
    return q


def test_q_values_of_large_tables(spark, tmp_path):
    found = core.bh_qvalues(spark, folder(spark, tmp_path)).collect()
    assert len(found) == len(LARGE) + 1 + len(CELLS)
    assert {r.event_pt: r.fdr_q for r in found if r.dataset_id == "large"} == {event: pytest.approx(q, abs=1e-6) for event, q in family_q().items()}
    assert all(r.fdr_q is not None for r in found)


def test_metrics_of_large_tables(spark, tmp_path):
    found = core.metrics_long(spark, folder(spark, tmp_path)).where("dataset_id = 'large'").collect()
    assert sorted((r.event_pt, r.method) for r in found) == [(f"E{n}", m) for n in range(len(LARGE) + 1) for m in ("fisher_exact", "prr", "ror")]
    tests, q = {r.event_pt: r for r in found if r.method == "fisher_exact"}, family_q()
    for n, t in enumerate([*LARGE, (20, 80, 40, 860)]):
        r = tests[f"E{n}"]
        assert (r.estimate, r.p_value, r.q_value) == pytest.approx((whole(*t), whole(*t), q[f"E{n}"]), abs=1e-6)
