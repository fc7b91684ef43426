import itertools
import random

import pytest
from pyspark.sql import functions as F

from sigmill import runtime
from sigmill.llm import cooccurrence, survivor
from sigmill.operators import incidence

COLUMNS = ", ".join(f"{c} string" for c in survivor.DEMO_FIELDS)


def demo(spark, rows):
    return spark.createDataFrame([tuple({"quarter": "2022Q1"}.get(c) if c not in r else r[c] for c in survivor.DEMO_FIELDS) + ("clash",) for r in rows], COLUMNS + ", currency string")


def case(caseid, primaryid, version="1", **other):
    return {"caseid": caseid, "primaryid": primaryid, "caseversion": version, **other}


def test_survivors(spark):
    rows = [
        case("1", "11", "9"), case("01", "12", "10"), case(" 1 ", "13", "2"),  # version as a number
        case("2", "9"), case("2", "10"),  # report number
        case("3", "31", quarter="2022Q1"), case("3", "31", quarter="2021Q4", sex="F"), case("3", "31", quarter="2023Q1", age=" ", serious="NA"),  # filled
        case("4", "41", quarter="Q1 2022"), case("4", "41", quarter="21Q4"), case("4", "41", quarter="2022-Q2"), case("4", "41", quarter="soon"),  # period
        case("5", "51"), case("6", "61"), case("6", "61"),  # alone; repeated
        case(None, "71"), case(None, "72"), case("x", "73"), case("x", "74"), case("NA", "75"), case("NA", "76"),
        case("8", "81", None), case("8", "82", "0001"), case("9", None), case("9", "UNK", quarter="2023Q1"),
        case("900719925474091000004331", "900719925474091000004331"), case("0900719925474091000004331", "900719925474091000004332"),
    ]
    got = {r.caseid: (r.primaryid, r.quarter) for r in survivor.survivors(demo(spark, rows)).collect()}
    assert got == {
        "1": ("12", "2022Q1"), "2": ("10", "2022Q1"), "3": ("31", "2021Q4"), "4": ("41", "2022-Q2"), "6": ("61", "2022Q1"), "8": ("82", "2022Q1"), "9": (None, "2023Q1"),
        "900719925474091000004331": ("900719925474091000004332", "2022Q1"),
    }
    assert survivor.survivors(demo(spark, rows).limit(0)).count() == 0


def test_learned_order_completes_the_stamps(spark):
    dated = [case(str(n), str(n), "1", fda_dt=f"2022010{1 + k}", sex=s) for n in range(1, 9) for k, s in enumerate(("U", "F"))]
    seen = survivor.transitions(demo(spark, dated), F.col("caseid"))
    assert {(r.field, r.earlier, r.later, r.n) for r in seen.collect()} == {("sex", "U", "F", 8)}
    assert {tuple(r) for r in survivor.precedence(seen).collect()} == {("sex", "U", "F")}
    others = [
        case("90", "5", sex="U"), case("90", "5", sex="F"),  # no dates: the learned order decides
        case("91", "5", sex="F"), case("91", "5", sex="U", fda_dt="20220101"),  # the undated value follows the dated one
        case("92", "5", sex="U"), case("92", "5", sex="F", fda_dt="20220101"),  # and here it doesn't
        case("93", "5", sex="M"), case("93", "5", sex="F", fda_dt="20220101"), case("94", "5", sex="M"), case("94", "5", sex="F"),  # nothing is known of M
        case("95", "5", "2", sex="U"), case("95", "5", "1", sex="F"),  # a stamp says more than what is learned
        case("96", "5", sex="F", fda_dt="20220101"), case("96", "5", sex="U", fda_dt="20220102"),  # so does a date
    ]
    fused = {r.case: r.sex for r in survivor.fused(demo(spark, dated + others)).collect()}
    assert {k: v for k, v in fused.items() if int(k) >= 90} == {"90": "F", "91": "F", "92": "F", "93": "F", "94": "M", "95": "U", "96": "U"}
    assert all(fused[str(n)] == "F" for n in range(1, 9))


def test_level_rows_are_told_apart_by_what_is_learned(spark):
    dated = [case(str(n), str(n), "1", fda_dt=f"2022010{1 + k}", sex=s) for n in range(1, 9) for k, s in enumerate(("U", "F"))]
    level = [case("90", "5", sex="F", quarter="2022-Q1"), case("90", "5", sex="U", quarter="22Q1"), case("91", "5", sex="U", quarter="2022-Q1"), case("91", "5", sex="F", quarter="22Q1"), case("92", "5", sex="M", quarter="22Q1"), case("92", "5", sex="F", quarter="2022Q1")]
    got = {r.caseid: r.quarter for r in survivor.survivors(demo(spark, dated + level)).collect()}
    assert (got["90"], got["91"], got["92"]) == ("2022-Q1", "22Q1", "22Q1")


def test_cycles_are_cut_and_the_order_is_closed(spark):
    rows = [("f", "a", "b", 9), ("f", "b", "c", 8), ("f", "c", "a", 2), ("g", "x", "y", 5), ("g", "y", "x", 5)] + [("h", f"v{n:03}", f"v{n + 1:03}", 9 + n) for n in range(100)]
    learned = {tuple(r) for r in survivor.precedence(spark.createDataFrame(rows, "field string, earlier string, later string, n long")).collect()}
    assert {r for r in learned if r[0] == "f"} == {("f", "a", "b"), ("f", "b", "c"), ("f", "a", "c")} and not [r for r in learned if r[0] == "g"]
    assert ("h", "v000", "v100") in learned and len([r for r in learned if r[0] == "h"]) == 101 * 50  # any number of values
    assert survivor.precedence(spark.createDataFrame([], "field string, earlier string, later string, n long")).count() == 0


def fused_by_hand(rows, order):
    out = {}
    value = lambda r, f: (r.get(f) or "").strip() if (r.get(f) or "").strip() not in ("", "NA") else None
    for key in {r["caseid"] for r in rows}:
        own = [r for r in rows if r["caseid"] == key]
        for f in ("sex", "serious", "age"):
            have = [r for r in own if value(r, f)]
            have = [r for r in have if (int(r["caseversion"]), int(r["primaryid"])) == max((int(x["caseversion"]), int(x["primaryid"])) for x in have)]
            last = max(((r["fda_dt"], value(r, f)) for r in have if r.get("fda_dt")), default=(None, None))[1]
            found = {value(r, f) for r in have if not r.get("fda_dt")} | ({last} if last else set())
            left = {v for v in found if f == "age" or not any((f, v, w) in order for w in found)}
            out[key, f] = last if last in left else max(left, default=None)
    return out


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_fused_records_against_the_definition(spark, monkeypatch, most):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", most)
    rng = random.Random(11)
    rows = [
        case(str(rng.choice([1, rng.randint(1, 60)])), str(rng.randint(1, 2)), str(rng.randint(1, 2)), fda_dt=rng.choice([None, f"202201{rng.randint(10, 30)}", f"202201{rng.randint(10, 30)}"]), sex=rng.choice(["U", "F", "M", "X", None]), serious=rng.choice(["1", "2", " 2 ", "NA"]), age=rng.choice(["5", "6", None]))
        for _ in range(400)
    ]
    df = demo(spark, rows)
    order = {tuple(r) for r in survivor.precedence(survivor.transitions(df, F.col("caseid"))).collect()}
    got = {(r.case, f): r[f] for r in survivor.fused(df).collect() for f in ("sex", "serious", "age")}
    assert order and got == fused_by_hand(rows, order)


def test_fused_record(spark):
    rows = [case("1", "11", "1", sex="F", age="50"), case("1", "12", "2", sex="NA", age=" 51 "), case("1", "13", "3", sex="", age=None), case("2", "21")]
    got = {r.case: r for r in survivor.fused(demo(spark, rows)).collect()}
    assert (got["1"].primaryid, got["1"].sex, got["1"].age, got["1"].rows, got["1"].fda_dt) == ("13", "F", "51", 3, None) and got["2"].rows == 1


PAIRS = "dataset_id string, primaryid string, drug_text string, event_pt string, n string, code string"


def brute(rows):
    rows = {r for r in rows if r[0] is not None and r[1] is not None}
    n = lambda test: len({r[1] for r in rows if test(r)})
    out = {}
    for d, x, y in {(r[0], r[2], r[3]) for r in rows if r[2] is not None and r[3] is not None}:
        out[d, x, y] = (n(lambda r: r[0] == d and r[2] == x and r[3] == y), n(lambda r: r[0] == d and r[2] == x), n(lambda r: r[0] == d and r[3] == y), n(lambda r: r[0] == d))
    return out


@pytest.mark.parametrize("rows_per_part, most", [(1 << 20, 1 << 20), (40, 0)])
def test_pairs_against_brute_force(spark, monkeypatch, rows_per_part, most):
    """With hot items of a third of all rows and more, also in parts and without broadcasts."""
    monkeypatch.setattr(incidence, "ROWS_PER_PART", rows_per_part)
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", most)
    rng = random.Random(6)
    rows = [(rng.choice("ab"), str(rng.randint(1, 60)), rng.choice(["HOT", "HOT", "x", "y", "", None]), rng.choice(["HOT", "e", "f", None])) for _ in range(900)]
    rows += [(None, "1", "x", "e"), ("a", None, "x", "e")] + [("c", str(n), "rare", "rare") for n in range(4)] + [("c", str(n), "other", "other") for n in range(20)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAIRS)
    got = {(r.dataset_id, r.drug_text, r.event_pt): (r.n, r.drug_n, r.event_n, r.universe) for r in cooccurrence.pair_counts(df).collect()}
    want = brute(rows)
    assert got == want
    frequent = {(r.dataset_id, r.drug_text, r.event_pt) for r in cooccurrence.frequent_pairs(df).collect()}
    assert frequent == {k for k, (n, d, e, u) in want.items() if n >= 4 and n * u >= 4 * d * e} and ("c", "rare", "rare") in frequent
    assert cooccurrence.pair_counts(df.limit(0)).count() == 0


def test_run_lengths_over_batches():
    import pyarrow as pa

    rows = sorted((c, r) for c, r in itertools.product((1, 2, 7), "aabbc"))
    want = {1: 3, 2: 3, 7: 3}
    for size in (1, 2, 4, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows[k : k + size]], pa.int64()), pa.array([r for _, r in rows[k : k + size]])], names=["code", "report"]) for k in range(0, len(rows), size)]
        got = [(c, n) for b in cooccurrence.run_lengths(iter(batches)) for c, n in zip(b.column("code").to_pylist(), b.column("n").to_pylist())]
        assert dict(got) == want and len(got) == 3
