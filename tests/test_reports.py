import random

import pytest
from fixture_tables import CELLS, DEMO_COLUMNS, DRUG_COLUMNS, REAC_COLUMNS, tables
from pyspark.sql import functions as F

from sigmill import errors, runtime
from sigmill.functions.ids import period, plain_id
from sigmill.functions.text import normalize_text, role_name, spreadsheet_safe, unknown_role
from sigmill.operators import cases, cells, incidence, pairs, quality


def demo_rows(spark, rows):
    return spark.createDataFrame([(p, c, v, None, None, None, None, None, q) for p, c, v, q in rows], DEMO_COLUMNS)


def test_current_reports_and_populations(spark):
    demo, drug, reac = tables(spark)
    current = cases.current_reports(demo)
    assert {r.primaryid for r in current.collect()} == {"1002", "2001", "3001", "4001"}
    built = pairs.report_pairs(current, drug, reac)
    row = quality.population_counts(demo, current, built).first()
    assert tuple(row) == (5, 4, 3, 5)
    quality.require_populations(demo, current, built)
    eligible = current.join(built.select("primaryid"), "primaryid", "left_semi")
    assert all(r.n_missing == 0 and r.n_reports == 3 for r in quality.field_completeness(eligible).collect())
    found = {r.component: (r.n_rows, r.n_unique) for r in quality.duplicate_components(pairs.drug_components(drug, current), pairs.event_components(reac, current)).collect()}
    assert found == {"drug": (4, 4), "event": (5, 4)}
    assert cases.superseded_children(drug, current).count() == cases.superseded_children(reac, current).count() == 1
    with pytest.raises(errors.PopulationError):
        quality.require_populations(demo, current, built.withColumn("primaryid", F.lit("1001")))


def test_golden_cells(spark):
    demo, drug, reac = tables(spark)
    made = cells.cells(pairs.report_pairs(cases.current_reports(demo), drug, reac), "fixture")
    rows = cells.ordered(made).collect()
    assert [(r.drug_text, r.drug_role, r.event_pt) for r in rows] == list(CELLS)
    for r in rows:
        assert (r.a, r.b, r.c, r.d, r.drug_reports, r.event_reports) == CELLS[r.drug_text, r.drug_role, r.event_pt]
        assert (r.universe_reports, r.drug_text_source) == (3, "PROD_AI")
    cells.require_valid(made)


def test_repeated_rows_change_nothing(spark):
    demo, drug, reac = tables(spark)
    current = cases.current_reports(demo)
    once = pairs.report_pairs(current, drug, reac)
    twice = pairs.report_pairs(current, drug.unionByName(drug), reac.unionByName(reac))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert twice.count() == twice.select("primaryid", "drug_text", "drug_text_source", "drug_role", "event_pt").distinct().count()


def test_ids_of_any_length(spark):
    huge = "900719925474099312345"
    rows = [("900719925474099312347", huge, "900719925474099312345", "2024Q1"), ("900719925474099312348", huge, "900719925474099312346", "2024Q1"), ("1001", "5", "1", "2024Q1"), ("1002", "5", "1", "2024Q1"), ("9", "6", "9", "2024Q1"), ("10", "6", "10", "2024Q1")]
    assert {r.primaryid for r in cases.current_reports(demo_rows(spark, rows)).collect()} == {"900719925474099312348", "1002", "10"}
    texts = [("001001", "1001"), (" 7 ", "7"), ("0", None), ("", None), (None, None), ("NA", None), ("12a", None), ("-3", None)]
    for r in spark.createDataFrame(texts, "x string, y string").select("y", plain_id(F.col("x")).alias("z")).collect():
        assert r.y == r.z
    with pytest.raises(errors.InvalidIdentifier):
        cases.require_ids(demo_rows(spark, [("1", "1", "not-a-number", "2024Q1")]), cases.DEMO_REQUIRED)


def test_integrity(spark):
    demo, drug, reac = tables(spark)
    assert vars(cases.require_integrity(demo, drug.withColumn("primaryid", F.concat(F.lit("00"), "primaryid")), reac)) == dict.fromkeys(("duplicate_primaryids", "duplicate_versions", "drug_orphans", "reac_orphans", "case_mismatches"), 0)
    with pytest.raises(errors.IntegrityError, match="drug_orphans"):
        cases.require_integrity(demo, drug.unionByName(spark.createDataFrame([("77", "7", "PS", "X", "X")], DRUG_COLUMNS)), reac)
    with pytest.raises(errors.IntegrityError, match="case_mismatches"):
        cases.require_integrity(demo, drug, reac.unionByName(spark.createDataFrame([("1002", "20", "X")], REAC_COLUMNS)))
    with pytest.raises(errors.IntegrityError, match="duplicate_primaryids"):
        cases.require_integrity(demo.unionByName(demo.limit(1)), drug, reac)


def test_budget_and_roles(spark):
    demo, drug, reac = tables(spark)
    current = cases.current_reports(demo)
    many_drugs = spark.createDataFrame([("1002", "10", "PS", f"D{n}", f"D{n}") for n in range(101)], DRUG_COLUMNS)
    many_events = spark.createDataFrame([("1002", "10", f"E{n}") for n in range(101)], REAC_COLUMNS)
    with pytest.raises(errors.JoinBudgetExceeded, match="1002 yields 10201"):
        pairs.report_pairs(current, many_drugs, many_events)
    assert pairs.report_pairs(current, many_drugs, many_events, limit=None).count() == 10201
    strange = spark.createDataFrame([("1002", "10", "NEW_ROLE", "X", "X")], DRUG_COLUMNS)
    with pytest.raises(errors.UnsupportedRole, match="NEW_ROLE"):
        pairs.report_pairs(current, strange, reac)
    superseded = spark.createDataFrame([("1001", "10", "NEW_ROLE", "X", "X")], DRUG_COLUMNS)
    assert pairs.report_pairs(current, drug.unionByName(superseded), reac).count() == 5


def test_text_rules(spark):
    rows = spark.createDataFrame([(" a\t\n b c ",), ("",), (None,), ("ps",), ("=1",), (" +x",), ("x=1",)], "x string")
    got = [r[0] for r in rows.select(normalize_text(F.col("x"))).collect()]
    assert got == ["A B C", "", None, "PS", "=1", "+X", "X=1"]
    assert [r[0] for r in rows.select(spreadsheet_safe(F.col("x"))).collect()][4:] == ["'=1", "' +x", "x=1"]
    roles = spark.createDataFrame([("PS",), (" ss ",), ("C",), ("i",), ("ZZ",), ("",), (None,), ("NA",)], "x string").select(role_name(F.col("x")), unknown_role(F.col("x"))).collect()
    assert [r[0] for r in roles] == ["primary_suspect", "secondary_suspect", "concomitant", "interacting", None, None, None, None]
    assert [r[1] for r in roles] == [False, False, False, False, True, False, False, False]


def test_product_name_stands_in_for_a_missing_ingredient(spark):
    demo, _, reac = tables(spark)
    drug = spark.createDataFrame([("1002", "10", "PS", "Brand", "NA"), ("1002", "10", "C", "Brand", None), ("1002", "10", "I", None, " "), ("2001", "20", None, "X", "X")], DRUG_COLUMNS)
    got = pairs.report_pairs(cases.current_reports(demo), drug, reac)
    assert {(r.drug_text, r.drug_text_source, r.drug_role) for r in got.collect()} == {("BRAND", "DRUGNAME", "primary_suspect"), ("BRAND", "DRUGNAME", "concomitant")}


def test_periods(spark):
    forms = ["2022Q3", "22Q3", "2022-Q3", "2022q3", "Q3 2022", "2022.3", " 2022Q3 "]
    rows = spark.createDataFrame([(x,) for x in [*forms, "2022Q5", "", None, "NA", "soon"]], "x string").select(period(F.col("x"))).collect()
    assert [r[0] for r in rows] == [2022 * 4 + 2] * len(forms) + [None] * 5


def test_violations(spark):
    good = ("d", "A", "PROD_AI", "all", "E", 1, 2, 3, 4, 3, 4, 10, cells.COMPARATOR, cells.EVENT_SCOPE, cells.DEDUPLICATION)
    names = [*cells.CELL_KEY, *cells.COUNTS, "comparator", "event_scope", "deduplication_policy"]

    def broken(**change):
        return spark.createDataFrame([tuple(change.get(n, v) for n, v in zip(names, good))], ", ".join(f"{n} {'long' if n in cells.COUNTS else 'string'}" for n in names))

    cells.require_valid(broken())
    for change in ({"drug_reports": 999}, {"universe_reports": 999}, {"a": -1}, {"d": 2**53}, {"d": 2**63 - 1, "b": 2**63 - 1}, {"event_pt": " "}, {"comparator": "x"}, {"a": None}):
        with pytest.raises(errors.InvalidTable):
            cells.require_valid(broken(**change))
    with pytest.raises(errors.InvalidTable, match="twice"):
        cells.require_valid(broken().unionByName(broken()))
    with pytest.raises(errors.InvalidTable, match="no cells"):
        cells.require_valid(broken().limit(0))
    with pytest.raises(errors.InvalidTable):
        cells.from_margins(spark.createDataFrame([(5, 4, 9, 20)], "a long, drug_reports long, event_reports long, universe_reports long"))


def test_empty_tables(spark):
    demo, drug, reac = (t.limit(0) for t in tables(spark))
    current = cases.current_reports(demo)
    built = pairs.report_pairs(current, drug, reac)
    assert built.count() == 0 and cells.cells(built, "x").count() == 0
    assert [r.missing_percent for r in quality.field_completeness(current).collect()] == [0.0] * 4


@pytest.mark.parametrize("most", [0, 1 << 20])
@pytest.mark.parametrize("rows_per_part", [50, 1 << 20])
def test_cells_of_hot_keys_against_brute_force(spark, monkeypatch, most, rows_per_part):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", most)
    monkeypatch.setattr(incidence, "ROWS_PER_PART", rows_per_part)
    rng = random.Random(2)
    roles = ["primary_suspect", "secondary_suspect", "concomitant", "interacting", "other"]
    rows = {(rng.choice("ab"), str(rng.choice([1, rng.randint(1, 80)])), rng.choice(["HOT", "HOT", "x", "y"]), rng.choice(["S", "T"]), rng.choice(roles), rng.choice(["HOT", "HOT", "e", "f"])) for _ in range(1500)}
    rows |= {("a", None, "x", "S", "other", "e"), ("a", "1", None, "S", "other", "e"), ("a", "1", "x", "S", None, "e"), (None, "1", "x", "S", "other", "e")}
    pairs = spark.createDataFrame([(*r, "clash", 7) for r in [*rows, *list(rows)[:300]]], "dataset_id string, primaryid string, drug_text string, drug_text_source string, drug_role string, event_pt string, report string, drug int")
    whole = [r for r in rows if None not in r]
    held = {(d, p, x, s, q, e) for d, p, x, s, r, e in whole for q in [*([r] if r != "other" else []), *(["suspect"] if r in roles[:2] else []), "all"]}
    n = lambda found: len(set(found))
    want = {}
    for key in {(d, x, s, q, e) for d, _, x, s, q, e in held}:
        d, x, s, q, e = key
        a, dr = n(h[1] for h in held if (h[0], *h[2:]) == key), n(h[1] for h in held if (h[0], *h[2:5]) == key[:4])
        er, total = n(h[1] for h in whole if h[0] == d and h[5] == e), n(h[1] for h in whole if h[0] == d)
        want[key] = (a, dr - a, er - a, total - dr - er + a, dr, er, total)
    got = cells.cells(pairs).collect()
    assert {tuple(r[c] for c in cells.CELL_KEY): tuple(r[c] for c in cells.COUNTS) for r in got} == want and len(got) == len(want)
