"""Tables that were measured to be too large for a broadcast aren't broadcast, whatever the optimiser guesses from the files."""

import pytest
from fixture_tables import CELLS
from pyspark.sql import functions as F

from sigmill import runtime
from sigmill.operators import multiplicity
from sigmill.operators.cells import COMPARATOR, DEDUPLICATION, EVENT_SCOPE
from sigmill.queries import core


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(f"s{n}", drug, "PROD_AI", role, event, a, b, c, d + n, drugs, events, 3 + n) for n in range(40) for (drug, role, event), (a, b, c, d, drugs, events) in CELLS.items()]
    names = "dataset_id string, drug_text string, drug_text_source string, drug_role string, event_pt string, a long, b long, c long, d long, drug_reports long, event_reports long, universe_reports long"
    constants = {"comparator": F.lit(COMPARATOR), "event_scope": F.lit(EVENT_SCOPE), "deduplication_policy": F.lit(DEDUPLICATION)}
    spark.createDataFrame(rows, names).withColumns(constants).write.parquet(str(tmp_path / "disproportionality_cells.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("query, n_rows", [(core.bh_qvalues, 520), (core.metrics_long, 1560), (core.result_revalidation, 293)])
def test_results_without_a_broadcast(spark, folder, monkeypatch, query, n_rows):
    want = sorted(map(str, query(spark, folder).collect()))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    found = query(spark, folder)
    assert sorted(map(str, found.collect())) == want and len(want) == n_rows
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def _repeated(spark, folder, target):
    rows = runtime.table(spark, folder, "disproportionality_cells")
    rows.unionByName(rows.where("a % 2 = 0")).unionByName(rows.where("dataset_id = 's3'")).repartition(3).write.parquet(f"{target}/disproportionality_cells.parquet")
    return str(target)


@pytest.mark.parametrize("query, n_rows", [(core.bh_qvalues, 520), (core.metrics_long, 1560)])
@pytest.mark.parametrize("rows_per_task", [multiplicity.ROWS_PER_TASK, 2])
def test_repeated_rows_count_once(spark, folder, tmp_path_factory, monkeypatch, query, n_rows, rows_per_task):
    want = sorted(map(str, query(spark, folder).collect()))
    monkeypatch.setattr(multiplicity, "ROWS_PER_TASK", rows_per_task)
    found = query(spark, _repeated(spark, folder, tmp_path_factory.mktemp("repeated")))
    assert sorted(map(str, found.collect())) == want and len(want) == n_rows


def test_cells_are_shuffled_and_sorted_once(spark, folder, monkeypatch):
    monkeypatch.setattr(multiplicity, "ROWS_PER_PARTITION", 50)
    found = core.metrics_long(spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Sort [") == 1
    assert "dataset_id" in plan[plan.index("Exchange hashpartitioning") :].split(")")[0] and ", 11)" in plan  # 520 rows


def test_a_large_lookup_is_no_broadcast(spark, folder):
    rows = runtime.table(spark, folder, "disproportionality_cells")
    found = runtime.lookup(rows.select("a", "b"), rows.groupBy("a").agg(F.count("*").alias("n")), ["a"], fits=False)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("n is null").count() == 0 and found.count() == 520
