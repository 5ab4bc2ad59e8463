"""Streams that end their state, and findings later than the watermark."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tracefold.streaming import incremental as ops

DAY = dt.datetime(2024, 1, 1)


def files(spark, path, batches, schema):
    """A file a batch, read in this order; each holds (.., minutes after the first day)."""
    for k, rows in enumerate(batches):
        table = spark.createDataFrame([(*r[:-1], DAY + dt.timedelta(minutes=r[-1])) for r in rows], schema)
        table.coalesce(1).write.parquet(f"{path}/b={k:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b=*")


def minutes(value):
    return round((value - DAY).total_seconds() / 60)


def run(stream, path, mode="append"):
    """All rows given, and the rows of state after each batch."""
    out, state = f"{path}/out", []
    query = stream.writeStream.foreachBatch(lambda rows, k: rows.write.parquet(f"{out}/part={k}")).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/part=*").collect(), state


def test_sessions_end_by_idleness_and_by_age(spark, tmp_path):
    hits = [("a", m) for m in (0, 50, 100, 150, 199, 230)] + [("b", 10), ("b", 500)] + [("c", 300)]
    rng = random.Random(1)
    late = sorted(hits, key=lambda h: h[1] + rng.randint(0, 50))
    batches = [late[:3], late[3:6], late[6:], [("z", 3000)], [("z", 6000)]]
    stream = files(spark, f"{tmp_path}/in", batches, "k string, ts timestamp")
    rows, state = run(ops.bounded_sessions(stream, "k", "ts", 3600, 12_000, "60 minutes"), str(tmp_path))
    got = sorted((r.k, minutes(r.started), minutes(r.ended), r.n, r.reason) for r in rows)
    assert got == [("a", 0, 200, 5, "absolute"), ("a", 230, 290, 1, "idle"), ("b", 10, 70, 1, "idle"), ("b", 500, 560, 1, "idle"), ("c", 300, 360, 1, "idle"), ("z", 3000, 3060, 1, "idle")]
    assert state[-1] <= 1 and max(state) <= 4


def test_throttle_forgets_closed_windows(spark, tmp_path):
    batches = [[(k, f"u{k}", 0) for k in range(30)] + [(100, "u0", 1), (101, "u0", 2)], [(200, "v", 500)], [(201, "w", 900)]]
    stream = files(spark, f"{tmp_path}/in", batches, "event_id long, k string, ts timestamp")
    rows, state = run(ops.throttled(stream, "k", "ts", 3600, 2, "60 minutes"), str(tmp_path))
    refused = [(r.event_id, r.retry_after) for r in rows if not r.allowed]
    assert refused == [(101, 3480.0)] and len(rows) == 34
    assert max(state) <= 31 and state[-1] <= 2


def test_idle_sessions_leave_the_state(spark, tmp_path):
    batches = [[(f"u{k}", 0) for k in range(20)], [("v", 1000)], [("w", 3000)]]
    stream = files(spark, f"{tmp_path}/in", batches, "k string, ts timestamp")
    rows, state = run(ops.sessions(stream, "k", "ts", "30 minutes", "60 minutes"), str(tmp_path))
    assert len(rows) == 21 and state[-1] <= 1


def test_late_findings_are_stored_once(spark, tmp_path):
    batches = [[("a", 10_000), ("b", 10_001)], [("a", 10_050), ("old", 5)], [("old", 6), ("old2", 7), ("old2", 8), ("a", 1)], [("b", 20_000), ("c", 20_000)], [("c", 9_000), ("d", 9_000)]]
    stream = files(spark, f"{tmp_path}/in", batches, "k string, ts timestamp")
    base = f"file://{tmp_path}/store"
    got = ops.stored_findings(stream, ["k"], "ts", "60 minutes", base)
    assert sorted(r.k for r in got.collect()) == ["a", "b", "c", "d", "old", "old2"]
    # The watermark alone would lose those that come late.
    kept, _ = run(ops.new_findings(stream, ["k"], "ts", "60 minutes"), str(tmp_path))
    assert {"a", "b", "c"} <= {r.k for r in kept} and not {"old2", "d"} & {r.k for r in kept}
    # Another start goes on, and stores what is new alone.
    spark.createDataFrame([("d", DAY), ("e", DAY)], "k string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/b=900")
    again = ops.stored_findings(spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*"), ["k"], "ts", "60 minutes", base)
    assert again.count() == again.select(F.countDistinct("k")).first()[0] == 7
