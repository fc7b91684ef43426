import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigmill import runtime
from sigmill.operators import drift, orphans

DEMO = [("1", "10", "2022Q1"), ("001", "10", "2022Q3"), ("2", "20", "2022Q3"), ("3", "30", "2021Q1"), (None, "9", "2021Q1"), ("5", "50", None)]
DELETED = [("0030", "2022Q2", "merged"), ("30", "2023Q1", None), (None, "2021Q1", None), ("77", "x", None)]
CHILD = [
    ("1", "2022Q1"), ("01", "2022Q1"), ("1", "2021Q4"), ("2", "2022Q2"), (" 2 ", "2022Q3"), ("3", "2022Q1"), ("3", "2022Q2"), ("3", "2023Q4"), ("4", "2022Q1"),
    ("4", "2022Q1"), (None, "2022Q1"), ("", "2022Q1"), ("UNK", "2022Q1"), ("5", "2022Q1"), ("6", None), ("1", None),
]
BROKEN = {("1", "2021Q4", "late"), ("2", "2022Q2", "late"), ("3", "2022Q2", "deleted"), ("3", "2023Q4", "deleted"), ("4", "2022Q1", "missing"), ("6", None, "missing")}


def frames(spark):
    demo = spark.createDataFrame(DEMO, "primaryid string, caseid string, quarter string")
    child = spark.createDataFrame(CHILD, "primaryid string, quarter string").withColumn("standing", F.lit("clash")).withColumn("table_name", F.lit("clash"))
    return demo, child, spark.createDataFrame(DELETED, "caseid string, quarter string, reason string")


@pytest.mark.parametrize("periods", [1, 4, 100])
def test_orphans_of_any_batch_size(spark, periods):
    demo, child, deleted = frames(spark)
    state = orphans.replay(demo, {"drug_all": child, "reac_all": child}, deleted, periods)
    got = orphans.broken(state).collect()
    assert {(r.primaryid, r.quarter, r.orphan_kind) for r in got if r.table_name == "reac_all"} == BROKEN
    assert len(got) == 2 * len(BROKEN)
    held = {(r.quarter, r.n_references) for r in orphans.snapshot(state).where("standing = 'held' and table_name = 'drug_all'").collect()}
    assert held == {("2022Q1", 3), ("2022Q3", 1), (None, 1)}
    assert len(state.settled) <= {1: 6, 4: 3, 100: 1}[periods]  # no batches of quarters that don't occur


def test_arrivals_settle_and_withdrawals_reopen(spark):
    demo, child, deleted = frames(spark)
    refs = orphans.references_of(child.where("primaryid in ('3', '4') and quarter = '2022Q2' or primaryid = '4'"), "t")
    nothing = orphans.empty_state(spark)
    standing = lambda state: {(r.primaryid, r.standing) for r in state.pending.rows.collect()}
    counted = lambda state: {(r.standing, r.n_references) for r in orphans.snapshot(state).collect()}
    first = orphans.advance(nothing, refs, orphans.parents_of(demo.limit(0)), orphans.withdrawals_of(deleted.limit(0)))
    assert standing(first) == {("3", "missing"), ("4", "missing")}
    second = orphans.advance(first, refs.limit(0), orphans.parents_of(demo), orphans.withdrawals_of(deleted.limit(0)))
    assert standing(second) == {("4", "missing")} and counted(second) == {("held", 1), ("missing", 1)}
    third = orphans.advance(second, refs.limit(0), orphans.parents_of(demo.limit(0)), orphans.withdrawals_of(deleted))
    assert standing(third) == {("3", "deleted"), ("4", "missing")} and counted(third) == {("deleted", 1), ("missing", 1)}
    # a batch that brings nothing settles and reopens nothing, and the same withdrawal again changes nothing
    fourth = orphans.advance(third, refs.limit(0), orphans.parents_of(demo.limit(0)), orphans.withdrawals_of(deleted))
    assert standing(fourth) == standing(third) and counted(fourth) == counted(third)
    assert [df.count() for df in (fourth.settled[-1].rows, fourth.parents[-1])] == [0, 0]
    # references brought before are no other references
    fifth = orphans.advance(fourth, refs, orphans.parents_of(demo.limit(0)), orphans.withdrawals_of(deleted.limit(0)))
    assert standing(fifth) == standing(third) and counted(fifth) == counted(third)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_any_order_of_batches_gives_the_plain_result(spark, monkeypatch, most):
    """Parents, references and withdrawals of random periods in random batches against the definition."""
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", most)
    rng = random.Random(9)
    quarter = lambda p: f"{p // 4}Q{p % 4 + 1}"
    demo = [(str(rng.choice([1, rng.randint(1, 40)])), str(rng.randint(1, 20)), quarter(rng.randint(8080, 8090))) for _ in range(60)]
    child = [(str(rng.choice([1, rng.randint(1, 60)])), quarter(rng.randint(8080, 8090))) for _ in range(150)]
    deleted = [(str(rng.randint(1, 20)), quarter(rng.randint(8080, 8090))) for _ in range(6)]
    state = orphans.empty_state(spark)
    for k in range(3):
        pick = lambda rows, k=k: [r for n, r in enumerate(rows) if n % 3 == k or n % 7 == k]
        parents = orphans.parents_of(spark.createDataFrame(pick(demo), "primaryid string, caseid string, quarter string"))
        gone = orphans.withdrawals_of(spark.createDataFrame(pick(deleted), "caseid string, quarter string"))
        state = orphans.advance(state, orphans.references_of(spark.createDataFrame(pick(child), "primaryid string, quarter string"), "t"), parents, gone)
    want = {}
    for p, q in set(child):
        came = [d for d in demo if d[0] == p]
        lost = [d[1] for d in deleted if d[0] in {x[1] for x in came} and d[1] <= q]
        want[p, q] = "missing" if not came else "late" if min(d[2] for d in came) > q else "deleted" if lost else "held"
    got = {(r.primaryid, r.quarter): r.orphan_kind for r in orphans.broken(state).collect()}
    assert got == {k: v for k, v in want.items() if v != "held"} and {"missing", "late", "deleted"} == set(got.values())
    counts = {(r.quarter, r.standing): r.n_references for r in orphans.snapshot(state).collect()}
    assert counts == Counter((q, v) for (_, q), v in want.items())


def test_no_references_at_all(spark):
    demo, child, deleted = (f.limit(0) for f in frames(spark))
    assert orphans.broken(orphans.replay(demo, {"drug_all": child}, deleted)).count() == 0


NAMES = [("demo", "caseid", "case_id"), ("demo", "caseid", "caseid"), ("demo", "quarter", "qtr"), ("cells", "a", "n11")]


def lines(spark, feeds):
    rows = []
    for (feed, kind), files in feeds.items():
        for n, text in files.items():
            rows += [(feed, kind, n, f"{feed}_{n}.txt", k, x) for k, x in enumerate(text)]
    return spark.createDataFrame(rows, "feed string, feed_kind string, file_no int, file_name string, line_no int, raw_line string")


def test_changes(spark):
    names = spark.createDataFrame(NAMES, "feed_kind string, field_name string, seen_as string")
    feeds = {
        ("f", "demo"): {
            1: [" Case ID_$age$x", "1$7$NA"],
            3: ["caseid$age", "NA$", "2$"],
            4: ["caseid$x$age$", "a$2024-01-01$1.5$"],
            5: ["x$caseid", "7$1"],
            6: ["caseid$age$x$", "1$9$"],
        },
        ("g", "cells"): {2: ["n11\ta b", "1\t2.0"], 5: ["a\ta-b", "1.0\t0.5", "\t"], 6: ["a", "2021-01-01"]},
    }
    got = {(r.feed, r.file_no, r.field_name, r.change_kind) for r in drift.changes(lines(spark, feeds), names).collect()}
    assert got == {
        ("f", 3, "x", "removed"), ("f", 3, "caseid", "renamed"),
        ("f", 4, "x", "added"), ("f", 4, "caseid", "retyped"), ("f", 4, "age", "retyped"),
        ("f", 5, "age", "removed"), ("f", 5, "x", "retyped"), ("f", 5, "caseid", "retyped"),
        ("f", 6, "age", "added"), ("f", 6, "age", "retyped"),
        ("g", 5, "a", "renamed"), ("g", 5, "a", "retyped"), ("g", 6, "a", "retyped"), ("g", 6, "a_b", "removed"),
    }
    assert drift.changes(lines(spark, feeds).limit(0), names).count() == 0
    assert drift.changes(lines(spark, feeds), names.limit(0)).where("field_name = 'n11'").count() == 1


def test_changes_against_brute_force(spark):
    rng = random.Random(5)
    fields, values = ["age", "sex", "case_id", "caseid", "zz"], ["1", "2.5", "2024-01-02", "x", "", "NA"]
    feeds = {}
    for k in range(12):
        files = {}
        for n in sorted(rng.sample(range(1, 20), 5)):
            head = rng.sample(fields[:2] + [rng.choice(fields[2:4])] + fields[4:], rng.randint(1, 4))
            files[n] = ["$".join(head)] + ["$".join(rng.choice(values) for _ in head) for _ in range(rng.randint(0, 3))]
        feeds[f"f{k}", "demo"] = files
    names = spark.createDataFrame(NAMES, "feed_kind string, field_name string, seen_as string")
    tied = {s: f for kind, f, s in NAMES if kind == "demo"}

    def kind(found):
        found = [v for v in found if v not in ("", "NA")]
        for name, pattern in (("integer", r"\d+"), ("decimal", r"\d+\.?\d*"), ("date", r"\d{4}-\d\d-\d\d"), ("text", ".*")):
            if found and all(re.fullmatch(pattern, v) for v in found):
                return name

    want = set()
    for (feed, _), files in feeds.items():
        read = []
        for n, text in files.items():
            head, rows = text[0].split("$"), [x.split("$") for x in text[1:]]
            read.append((n, {tied.get(h, h): (h, kind([r[i] for r in rows])) for i, h in enumerate(head)}))
        for (_, old), (n, new) in itertools.pairwise(read):
            want |= {(feed, n, f, "added") for f in new.keys() - old.keys()} | {(feed, n, f, "removed") for f in old.keys() - new.keys()}
            want |= {(feed, n, f, "renamed") for f in new.keys() & old.keys() if new[f][0] != old[f][0]}
            for f, (_, t) in new.items():
                earlier = [o[f][1] for m, o in read if m < n and f in o and o[f][1]]
                if t and earlier and earlier[-1] != t:
                    want.add((feed, n, f, "retyped"))
    assert {tuple(r) for r in drift.changes(lines(spark, feeds), names).select("feed", "file_no", "field_name", "change_kind").collect()} == want


def test_unified_table(spark):
    names = spark.createDataFrame(NAMES, "feed_kind string, field_name string, seen_as string")
    feeds = {("f", "demo"): {1: ["case_id$qtr$x", " 7 $22Q3$u", "NA$$"], 2: ["quarter$caseid", "2024-01-05$c"]}, ("g", "cells"): {1: ["n11", "3"]}}
    rows = {(r.file_no, r.line_no): r for r in drift.unified(lines(spark, feeds), names, "demo").collect()}
    assert (rows[1, 1].caseid, rows[1, 1].caseid_number, rows[1, 1].quarter_period, rows[1, 1].other) == ("7", 7.0, "2022Q3", {"x": "u"})
    assert (rows[1, 2].caseid, rows[1, 2].quarter) == (None, None)
    # a name that isn't listed stands for itself, here for a listed field
    assert (rows[2, 1].caseid, rows[2, 1].caseid_number, str(rows[2, 1].quarter_date), rows[2, 1].quarter_period, rows[2, 1].other) == ("c", None, "2024-01-05", None, {})
