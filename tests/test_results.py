import itertools
import random

import pytest
from fixture_tables import DRUG_COLUMNS, tables
from pyspark.sql import functions as F
from test_orphans_and_drift import NAMES, lines

from sigmill import errors
from sigmill.functions.stats import with_statistics
from sigmill.operators import cases, cells, drift, metrics, pairs, quality, ranking, revalidate
from sigmill.sources import delimited


def test_shortest_texts(spark):
    texts = {1.0: "1", 0.5: "0.5", 123456.0: "123456", 1234567.0: "1.234567e+06", 1e-05: "1e-05", 1.5e-07: "1.5e-07", 0.0001: "0.0001", -2.25: "-2.25", 1e300: "1e+300", 0.0: "0", 0.1 + 0.2: "0.30000000000000004"}
    rows = spark.createDataFrame([(x,) for x in [*texts, None, float("nan"), float("-inf")]], "x double").select("x", metrics.shortest(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [*texts.values(), None, "NaN", "-Inf"] and all(float(t) == x for x, t in texts.items())


def test_export(spark, tmp_path):
    base = with_statistics(spark.createDataFrame([("=B", 20, 80, 40, 860), ('A,"x"', 0, 1, 2, 3)], "event_pt string, a long, b long, c long, d long"))
    rows = metrics.with_metrics(base.withColumns({"fisher_p": F.lit(0.25), "fdr_q": F.lit(None).cast("double")}), ("prr", "fisher_exact"))
    out = metrics.export_rows(rows, "id", "digest", "family", "source:=X", "pt", "NONE")
    assert out.columns == metrics.EXPORT and len(out.columns) == 25
    metrics.write_export(out, str(tmp_path / "e"))
    back = spark.read.options(header=True, quote='"', escape='"').csv(str(tmp_path / "e")).orderBy("result_row_number", "method").collect()
    assert [(r.result_row_number, r.event_term, r.method, r.n) for r in back] == [("1", "'=B", "fisher_exact", "1000"), ("1", "'=B", "prr", "1000"), ("2", 'A,"x"', "fisher_exact", "6"), ("2", 'A,"x"', "prr", "6")]
    assert (back[1].estimate, back[1].zero_cell_correction_applied, back[1].added_to_each_cell, back[3].added_to_each_cell, back[0].p_value, back[0].q_value) == ("4.5", "false", "0", "0.5", "0.25", None)
    with pytest.raises(Exception, match="exist"):
        metrics.write_export(out, str(tmp_path / "e"))


@pytest.fixture(scope="module")
def made(spark):
    demo, drug, reac = tables(spark)
    return cells.cells(pairs.report_pairs(cases.current_reports(demo), drug, reac), "fixture").cache()


def test_store_is_whole_or_absent(spark, made, tmp_path):
    other = made.withColumns({"dataset_id": F.lit("other"), "drug_text_source": F.lit(None).cast("string")})
    delimited.write_cells(made.unionByName(other), str(tmp_path / "s"))
    back = delimited.read_cells(spark, str(tmp_path / "s"))
    assert back.count() == 26 and back.where("dataset_id = 'other' and drug_text_source is null").count() == 13 and back.columns == made.columns
    bad = (made.withColumn("d", F.col("d") + 1), made.unionByName(made.limit(1)), made.limit(0), made.unionByName(made.limit(1).withColumns({"drug_text": F.lit("x"), "d": F.col("d") + 1, "universe_reports": F.col("universe_reports") + 1})))
    for n, frame in enumerate(bad):
        with pytest.raises(errors.InvalidTable):
            delimited.write_cells(frame, str(tmp_path / f"b{n}"))
    assert [p.name for p in tmp_path.iterdir()] == ["s"]


def test_pages_in_all_orders(spark):
    rng = random.Random(4)
    rows = [(g, f"e{n:03}", rng.choice([None, float("nan"), 1.0, 2.0, 3.0]), rng.randint(0, 5), rng.choice("xy")) for g, size in (("g", 23), ("h", 7), ("i", 10), (None, 3)) for n in range(size)]
    df = spark.createDataFrame(rows, "g string, event_pt string, prr double, a long, outcome string")
    keys = {"prr": lambda r: (-r[2] if r[2] is not None and r[2] == r[2] else 1, r[1]), "count": lambda r: (-r[3], r[1]), "name": lambda r: r[1]}
    for (order, key), number, outcome, grouped in itertools.product(keys.items(), (1, 2, 9), (None, "x"), (True, False)):
        if number == 9 and order == "name":
            continue
        shown = [r for r in rows if outcome in (None, r[4])]
        want = set()
        for g in {r[0] if grouped else 0 for r in shown}:
            own = sorted((r for r in shown if not grouped or r[0] == g), key=key if grouped else lambda r: (key(r), str(r[0])))
            at = min(number, -(-len(own) // 5))
            want |= {(n + 1, r[1]) for n, r in enumerate(own) if at * 5 - 5 <= n < at * 5}
        got = ranking.page(df, number, ("g",) if grouped else (), 5, order, outcome).collect()
        assert {(r.place, r.event_pt) for r in got} == want


def test_rows_out_of_order(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "b", "x"), (4, "b", "y"), (5, "a", "z"), (7, "z", "z")]
    got = revalidate.out_of_order(spark.createDataFrame(rows, "number long, event_pt string, drug_text string"), "number").collect()
    assert sorted(r.number for r in got) == [3, 5, 7]


def test_text_checks(spark):
    rows = spark.createDataFrame([("d", b"ok"), ("d", b"ok"), ("d", b"\xff"), ("e", None)], "dataset_id string, raw binary").select("dataset_id", F.col("raw").cast("string").alias("t"))
    assert {tuple(r) for r in revalidate.text_checks(rows, ("dataset_id", "t")).collect()} == {("d", 3, 1, 1), ("e", 1, 0, 0)}


def test_guards_and_eligible_reports(spark):
    demo, drug, reac = tables(spark)
    current = cases.current_reports(demo)
    strange = drug.unionByName(spark.createDataFrame([("1002", "10", "NEW", "X", "X"), ("1001", "10", "NEW", "X", "X")], DRUG_COLUMNS))
    assert tuple(pairs.build_guards(current, strange, reac, 1).first()) == (2, "2001", 3, 2, 1)
    assert tuple(pairs.build_guards(current, strange.limit(0), reac).first()) == (0, None, 0, 0, 0)
    built = pairs.report_pairs(current, drug, reac)
    assert quality.eligible_reports(current, built).count() == 3
    with pytest.raises(errors.PopulationError):
        quality.eligible_reports(current, built.withColumn("primaryid", F.lit("1001")))
    placed = [(r.primaryid, r.place, r.drug_text) for r in pairs.ordered_pairs(built).collect()]
    assert placed == sorted(placed) and [p for p in placed if p[0] == "2001"] == [("2001", 1, "ASPIRIN"), ("2001", 2, "IBUPROFEN")]
    counts = {r.metric: r.value for r in quality.summary(demo, drug, reac, current, pairs.drug_components(drug, current), pairs.event_components(reac, current), built, cells.cells(built, "x")).collect()}
    assert list(counts) == quality.SUMMARY and len(counts) == 27
    assert [counts[k] for k in ("source_demo_rows", "current_case_reports", "eligible_reports", "drug_event_pairs", "aggregate_rows")] == [5, 4, 3, 5, 13]
    assert [counts[k] for k in ("eligible_drug_component_rows", "unique_drug_components", "eligible_reaction_component_rows", "unique_reaction_components", "duplicate_reaction_components_removed")] == [4, 4, 5, 4, 1]
    assert [counts[k] for k in ("max_projected_pairs_per_report", "reports_with_joinable_components", "drug_rows_for_superseded_reports", "reaction_rows_for_superseded_reports")] == [2, 3, 1, 1]
    assert not any(counts[k] for k in counts if "orphan" in k or "mismatch" in k or k == "demo_duplicate_primaryids")


def test_alternatives_of_a_field(spark):
    names = spark.createDataFrame(NAMES, "feed_kind string, field_name string, seen_as string")
    feeds = {("f", "demo"): {1: ["age$x", "7$NA", "$"], 2: ["age$x", "8$1.5", "2024-01-01$"], 4: ["x$age", "u$3", "1$x", "2.5$x"]}}
    got = {tuple(r) for r in drift.alternatives(lines(spark, feeds), names).select("file_no", "field_name", "branch", "n_values").collect()}
    assert got == {(2, "age", "date", 1), (4, "age", "text", 2), (4, "x", "integer", 1), (4, "x", "text", 1)}
    assert drift.alternatives(lines(spark, feeds).limit(0), names).count() == 0
    values = {tuple(r) for r in drift.values(lines(spark, feeds), names, "demo").collect()}
    assert ("f", 4, 2, "age", "x") in values and ("f", 2, 1, "x", "1.5") in values and len(values) == 10


def test_codes_of_a_source(spark):
    rows = spark.createDataFrame([("prod_ai",), ("AI",), ("Drug Name",), ("DN",), ("1",), ("0.0",), (None,)], "x string").select(drift.canonical_source(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["PROD_AI", "PROD_AI", "DRUGNAME", "DRUGNAME", None, None, None]


def test_feeds_of_an_unknown_kind_are_an_error(spark):
    names = spark.createDataFrame(NAMES, "feed_kind string, field_name string, seen_as string")
    with pytest.raises(Exception, match="no separator is known"):
        drift.changes(lines(spark, {("f", "other"): {1: ["a,b", "1,2"]}}), names).collect()
