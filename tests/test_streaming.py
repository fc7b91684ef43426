from test_orphans_and_drift import BROKEN, frames

from sigmill.operators import orphans
from sigmill.streaming import orphan_stream


def test_stream_ends_in_the_state_of_the_replay(spark, tmp_path):
    demo, child, deleted = frames(spark)
    source, folder = tmp_path / "in", str(tmp_path / "out")
    parts = [orphan_stream.event_rows(child.limit(9), "t"), orphan_stream.event_rows(deleted, "deleted_cases"), orphan_stream.event_rows(demo, "demo_all"), orphan_stream.event_rows(child, "t")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(orphan_stream.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    orphan_stream.start(stream, folder).awaitTermination(300)
    state = orphan_stream.load_state(spark, folder, 3)
    assert {(r.primaryid, r.quarter, r.orphan_kind) for r in orphans.broken(state).collect()} == BROKEN
    assert spark.read.parquet(f"{folder}/snapshots").select("batch").distinct().count() == 4
    kept = lambda: sorted(map(str, (s := orphan_stream.load_state(spark, folder, 3)).pending.rows.union(s.counts.selectExpr("table_name", "period", "standing", "int(n_references)", "0", "''")).collect()))
    before = kept()
    last = parts[-1]
    orphan_stream.advance_batch(last, 3, folder)  # run again, as after a failure
    assert kept() == before and sorted(p.name for p in (tmp_path / "out/pending").iterdir()) == ["batch=2", "batch=3"]
