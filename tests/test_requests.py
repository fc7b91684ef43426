import dataclasses
import json
import zipfile

import pytest
from fixture_tables import tables
from pyspark.sql import functions as F

from sigmill import errors
from sigmill.operators import cases, cells, live, pairs
from sigmill.plans import engine
from sigmill.plans.protocol import Protocol, analysis_id, normalise
from sigmill.plans.store import ResultStore
from sigmill.sources import delimited, register

REQUEST = Protocol("fixture", "faers-prod_ai:ASPIRIN", "all", ("prr", "fisher_exact"), "evans_educational")


@pytest.fixture(scope="module")
def fixture_cells(spark):
    demo, drug, reac = tables(spark)
    return cells.cells(pairs.report_pairs(cases.current_reports(demo), drug, reac), "fixture").cache()


def test_request_is_normalised():
    loose = Protocol(" fixture ", "FAERS-PROD_AI:Aspirin", " ALL ", (" PRR", "ror", "prr"), "none")
    q = normalise(loose)
    assert (q.dataset_id, q.drug_role, q.methods, q.drug()) == ("fixture", "all", ("prr", "ror"), ("PROD_AI", "Aspirin"))
    assert analysis_id(loose, "m") == analysis_id(q, "m") != analysis_id(q, "n")
    for change in ({"dataset_id": "../x"}, {"drug_role": "any"}, {"methods": ()}, {"methods": ("prr", "magic")}, {"start_date": "2024-13-01"}, {"start_date": "2024-02-01", "end_date": "2024-01-01"}, {"threshold_profile": "mine"}, {"subgroups": (("sex", ()),)}):
        with pytest.raises(errors.InvalidProtocol):
            normalise(dataclasses.replace(REQUEST, **change))


def test_analysis(fixture_cells):
    rows = engine.analyse(fixture_cells, REQUEST).collect()
    assert [r.event_pt for r in rows] == ["HEADACHE", "NAUSEA", "RASH"]
    assert [m.method for m in rows[0].metrics] == ["fisher_exact", "prr"] and rows[0].flag == "below_profile"
    assert all(r.fisher_p == 1 and r.fdr_q == 1 for r in rows)
    assert engine.analyse(fixture_cells, dataclasses.replace(REQUEST, methods=("prr",), threshold_profile="none")).first().fisher_p is None


def test_analysis_fails_closed(fixture_cells):
    with pytest.raises(errors.NoMatchingRows):
        engine.analyse(fixture_cells, dataclasses.replace(REQUEST, drug_concept_id="faers-prod_ai:aspirin"))
    with pytest.raises(errors.BatchMethodRequired):
        engine.analyse(fixture_cells, dataclasses.replace(REQUEST, methods=("gps_ebgm",)))
    with pytest.raises(errors.BatchMethodRequired):
        engine.analyse(fixture_cells, dataclasses.replace(REQUEST, subgroups=(("sex", ("F",)),)))
    with pytest.raises(errors.ResultTooLarge):
        engine.analyse(fixture_cells, REQUEST, most=2)
    with pytest.raises(errors.InvalidTable):
        engine.analyse(fixture_cells.withColumn("d", F.col("d") + 1), REQUEST)


def test_store(spark, fixture_cells, tmp_path):
    rows = engine.analyse(fixture_cells, REQUEST)
    columns = ("drug_text", "event_pt", "a", "prr", "fisher_p")
    store, name = ResultStore(tmp_path / "store"), analysis_id(REQUEST, "m")
    assert store.save(name, rows, columns) and not store.save(name, rows, columns)
    assert store.load(spark, name).count() == 3
    with pytest.raises(errors.ImmutableConflict):
        store.save(name, rows.withColumn("a", F.col("a") + 1), columns)
    with pytest.raises(errors.InvalidProtocol):
        store.save("../x", rows, columns)
    for n in "12":
        store.export(name, tmp_path / f"{n}.zip")
    assert (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes()


def test_live_scan(spark):
    demo, drug, reac = tables(spark)
    reports = pairs.report_pairs(cases.current_reports(demo), drug, reac)
    one, everything = live.scan(reports, " aspirin "), live.scan_all(reports)
    assert [(r.event_pt, r.a, r.b, r.c, r.d) for r in one.collect()] == [("HEADACHE", 1, 2, 0, 0), ("NAUSEA", 2, 1, 0, 0), ("RASH", 1, 2, 0, 0)]
    assert {(r.event_pt, r.a, r.prr, r.label) for r in one.collect()} == {(r.event_pt, r.a, r.prr, r.label) for r in everything.where("drug_text = 'ASPIRIN'").collect()}
    for bad in ("", "x" * 121, "a\nb"):
        with pytest.raises(errors.InvalidProtocol):
            live.scan(reports, bad)
    with pytest.raises(errors.NoMatchingRows):
        live.scan(reports, "nothing")


def test_delimited_scan(spark, tmp_path):
    (tmp_path / "d.txt").write_text('PRIMARYID$Case-ID$ROLE COD$DRUGNAME$PROD_AI$EXTRA\n1$10$PS$ "A" $NA$x\n2$20$SS$$B$y\n')
    rows = delimited.scan(spark, str(tmp_path / "d.txt"), "drug").withColumnRenamed("case_id", "c").collect()
    assert [(r.primaryid, r.role_cod, r.drugname, r.prod_ai, r.route) for r in rows] == [("1", "PS", '"A"', None, None), ("2", "SS", None, "B", None)]
    with pytest.raises(errors.HeaderCollision):
        delimited.normalised_names(["CASE-ID", "CASE ID"])
    (tmp_path / "e.txt").write_text("primaryid$x\n1$2\n")
    with pytest.raises(errors.MissingColumns):
        delimited.scan(spark, str(tmp_path / "e.txt"), "reac")
    (tmp_path / "r.txt").write_text("primaryid$caseid$pt\n1$10$X\n")
    assert {r.quarter for r in delimited.scan_quarters(spark, {"2024Q1": str(tmp_path / "r.txt"), "2024Q2": str(tmp_path / "r.txt")}, "reac").collect()} == {"2024Q1", "2024Q2"}


def test_cell_sinks(spark, fixture_cells, tmp_path):
    delimited.write_cells_text(fixture_cells, str(tmp_path / "t"))
    back = delimited.read_cells_text(spark, str(tmp_path / "t"))
    assert sorted(map(str, back.collect())) == sorted(map(str, fixture_cells.collect()))
    delimited.write_cells(fixture_cells, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 13
    with pytest.raises(Exception, match="exist"):
        delimited.write_cells(fixture_cells, str(tmp_path / "p"))
    with pytest.raises(errors.UnsafeText):
        delimited.write_cells_text(fixture_cells.withColumn("drug_text", F.lit("=1")), str(tmp_path / "u"))


def test_register():
    assert register.coverage("2024Q1") == ("2024-01-01", "2024-03-31") and register.coverage("2023Q4") == ("2023-10-01", "2023-12-31")
    assert register.classify("ASCII/DEMO24Q1.txt") == ("demo", "2024Q1") and register.classify("reac2024q2.TXT") == ("reac", "2024Q2") and register.classify("README.txt") is None
    row = dict(quarter="2024Q1", file="a.zip", source_url="https://files.example.org/a.zip", retrieved_at="2024-05-01T00:00:00Z", coverage_start="2024-01-01", coverage_end="2024-03-31", sha256="a" * 64)
    register.check_register([row], "example.org")
    for change in ({"coverage_end": "2024-04-01"}, {"sha256": ""}, {"source_url": "https://example.org.evil.net/a"}, {"source_url": "http://example.org/a"}, {"retrieved_at": "2024-05-01"}, {"quarter": "24Q1"}):
        with pytest.raises(errors.InvalidRegister):
            register.check_register([row | change], "example.org")
    with pytest.raises(errors.InvalidRegister):
        register.check_quarter_files(["DEMO24Q1.txt", "DRUG24Q2.txt", "REAC24Q1.txt"], "2024Q1")


def test_archive(tmp_path):
    def made(name, members, level=zipfile.ZIP_STORED):
        with zipfile.ZipFile(tmp_path / name, "w", level) as z:
            for n, text in members.items():
                z.writestr(n, text)
        return tmp_path / name

    good = made("g.zip", {f"ASCII/{k}24Q1.txt": "x" for k in ("DEMO", "DRUG", "REAC")})
    assert set(register.unpack(good, tmp_path / "out", "2024Q1")) == {"demo", "drug", "reac"}
    for bad in (made("a.zip", {"../x": "1"}), made("b.zip", {f"f{n}": "1" for n in range(129)}), made("c.zip", {"z": "0" * 10**6}, zipfile.ZIP_DEFLATED)):
        with pytest.raises(errors.ArchiveRejected):
            register.check_archive(bad)
    with pytest.raises(errors.ArchiveRejected):
        register.check_archive(good, size=2)


def test_registry(tmp_path):
    content = dict(dataset_id="fixture", title="t", coverage_start="2024-01-01", coverage_end="2024-03-31", counts=[5, 4, 3, 5])
    (tmp_path / "a.json").write_text(json.dumps(content))
    found = register.Registry(tmp_path)
    assert [m.dataset_id for m in found.list()] == ["fixture"] and len(found.require("fixture").hash()) == 64
    with pytest.raises(errors.DatasetNotFound):
        found.require("other")
    for change in ({"counts": [3, 4, 3, 5]}, {"extra": 1}, {"dataset_id": "A/B"}, {"coverage_end": "2023-01-01"}):
        with pytest.raises(errors.InvalidManifest):
            register.manifest(content | change)
    (tmp_path / "b.json").write_text(json.dumps(content))
    with pytest.raises(errors.InvalidManifest, match="twice"):
        register.Registry(tmp_path)


def test_digest_of_all_rows_in_any_order(spark):
    rows = spark.range(60_000).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("b"))
    last = rows.withColumn("b", F.when(F.col("a") == 59_999, F.lit("y")).otherwise(F.col("b")))
    found = engine.result_digest(rows, ("a", "b"))
    assert found == engine.result_digest(rows.orderBy(F.desc("a")), ("a", "b"))
    assert found != engine.result_digest(last, ("a", "b")) and found != engine.result_digest(rows.unionByName(rows.limit(1)), ("a", "b"))
    assert engine.result_digest(rows.limit(0), ("a", "b")) == engine.result_digest(last.limit(0), ("a", "b")) != found
