"""Incremental behaviour as Structured Streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tables import shared_folder


def stream_of(spark: SparkSession, path: str, files_a_batch: int = 4) -> DataFrame:
    """A stream of the Parquet file or folder at `path`; local times are read as UTC."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may match one file, a plain path may not
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(pattern)
    return rows.select(*(F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in schema.fields))


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all there is now, into a table in the shared folder, and reads that. In
    update mode the last row of each key is for the caller to take: rows carry their batch."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("__batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/rows/part={batch}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])).parquet(f"{base}/rows/part=*")


def new_findings(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Findings whose key wasn't seen within the watermark; rows that come later than it are left
    out. `stored_findings` takes those too."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def stored_findings(stream: DataFrame, keys: list[str], at: str, delay: str, base: str | None = None) -> DataFrame:
    """The table of findings, each key once however far apart its rows come, none lost for being late.

    Rows within the watermark are first held against the state of recent keys, which drops most
    repeats without reading the table, then against the table. Rows that come later than `delay`
    after the latest time of the batches before theirs don't pass the state; a second query over the
    same stream takes them and holds them against the table. A batch that runs again overwrites its
    own part. With `base`, a shared folder of the caller's, a later start goes on from there.
    """
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"

    def table(tier: str, batch: int) -> DataFrame:
        """What is stored, without the batch's own earlier attempt."""
        every = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("tier", T.StringType()), T.StructField("part", T.LongType())])).parquet(f"{base}/rows")
        return every.filter((F.col("tier") != tier) | (F.col("part") != batch))

    def keep(tier: str, rows: DataFrame, batch: int) -> None:
        path = f"{base}/rows/tier={tier}/part={batch}"
        first = rows.dropDuplicates(keys)
        if _exists(spark, f"{base}/rows"):
            first = first.join(table(tier, batch).select(*keys), keys, "left_anti")
        first.select(*stream.columns).write.mode("overwrite").parquet(path)  # its own part isn't read

    def late(rows: DataFrame, batch: int) -> None:
        """Rows at or before the watermark that the batches before this one make."""
        times = rows.agg(F.max(at).alias("latest"))
        times.write.mode("overwrite").parquet(f"{base}/times/part={batch}")
        if batch == 0:
            return
        seen = spark.read.schema(T.StructType([*times.schema.fields, T.StructField("part", T.LongType())])).option("basePath", f"{base}/times").parquet(f"{base}/times/part=*").filter(F.col("part") < batch)
        mark = seen.agg(F.max("latest")).scalar() - F.expr(f"INTERVAL {delay}")
        keep("late", rows.filter(F.col(at) <= mark), batch)

    def run(source: DataFrame, name: str, each) -> None:
        query = source.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/{name}-state")
        query.trigger(availableNow=True).start().awaitTermination()

    run(new_findings(stream, keys, at, delay), "fresh", lambda rows, batch: keep("fresh", rows, batch))
    run(stream, "late", late)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows").select(*stream.columns)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def counters(stream: DataFrame, key: str) -> DataFrame:
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_at"))


def sessions(stream: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """Sessions that end after an idle gap; one is given, and its state dropped, when the watermark
    has passed its end."""
    window = F.session_window(at, gap)
    return stream.withWatermark(at, delay).groupBy(key, window.alias("session")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session.start").alias("started"), F.col("session.end").alias("ended"), "n")


def closed_sessions(stream: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """All sessions of what there is now, those too that the watermark hasn't passed: when the stream
    has been read, one row of a far later time and no key, in a folder of its own that was empty until
    then, moves the watermark past every end. That row's own session stays open."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    mark = spark.range(1).select(F.lit(None).cast(stream.schema[key].dataType).alias(key), F.lit("9999-01-01").cast("timestamp").alias(at))
    mark.limit(0).write.parquet(f"{base}/mark")
    marks = spark.readStream.schema(mark.schema).parquet(f"{base}/mark")
    found = sessions(stream.select(key, at).unionByName(marks), key, at, gap, delay)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/part={batch}")

    def run() -> None:
        query = found.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{base}/state")
        query.trigger(availableNow=True).start().awaitTermination()

    run()
    mark.write.mode("append").parquet(f"{base}/mark")
    run()
    return spark.read.schema(found.schema).parquet(f"{base}/rows/part=*")


def bounded_sessions(stream: DataFrame, key: str, at: str, idle: float, longest: float, delay: str) -> DataFrame:
    """Sessions (key, started, ended, n, reason) that end `idle` seconds after their last hit, or
    `longest` seconds after their first one, whichever is sooner; the next hit begins another.

    Hits may come in any order within the watermark: a key holds those that it hasn't passed, and its
    open session. Both are gone once it has, so state is bounded by the keys that were lately active.
    """
    idle_ms, longest_ms = round(idle * 1000), round(longest * 1000)

    def step(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, last, n, waiting = state.get if state.exists else (None, None, 0, [])
        mark = state.getCurrentWatermarkMs()
        waiting = sorted([*waiting, *(int(t) for rows in batches for t in rows["ms"])])
        done: list[tuple] = []

        def end() -> tuple[int, str]:
            return (opened + longest_ms, "absolute") if opened + longest_ms <= last + idle_ms else (last + idle_ms, "idle")

        while waiting and waiting[0] <= mark:
            now = waiting.pop(0)
            if opened is not None and (now > last + idle_ms or now >= opened + longest_ms):
                done.append((opened, *end(), n))
                opened = None
            if opened is None:
                opened, n = now, 0
            last, n = now, n + 1
        if opened is not None and end()[0] < mark and not (waiting and waiting[0] <= end()[0]):
            done.append((opened, *end(), n))
            opened = None
        if opened is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((opened, last, n, waiting))
            state.setTimeoutTimestamp(max(mark + 1, min([*waiting[:1], *([end()[0]] if opened is not None else [])])))
        if done:
            yield pd.DataFrame({"key": [group[0]] * len(done), "started_ms": [x[0] for x in done], "ended_ms": [x[1] for x in done], "n": [x[3] for x in done], "reason": [x[2] for x in done]})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(at, delay).withColumn("ms", F.unix_millis(at))
    found = rows.groupBy(key).applyInPandasWithState(step, f"key {kind}, started_ms long, ended_ms long, n long, reason string", "opened long, last long, n long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").alias(key), F.timestamp_millis("started_ms").alias("started"), F.timestamp_millis("ended_ms").alias("ended"), "n", "reason")


def tumbling(stream: DataFrame, key: str, at: str, width: str, delay: str, limit: int) -> DataFrame:
    """Hits of each fixed window, and whether they passed the limit: for monitoring."""
    held = stream.withWatermark(at, delay).groupBy(key, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return held.select(key, F.col("w.start").alias("opened"), "n", (F.col("n") <= limit).alias("allowed"))


def throttled(stream: DataFrame, key: str, at: str, seconds: int, limit: int, delay: str) -> DataFrame:
    """Exact verdicts: a window opens at a key's first hit; hits after `limit` are refused until it
    closes. Hits of a batch are taken in order of time and id, those behind the watermark are left
    out. State is one window a key, gone when the watermark passes its close."""

    def judge(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        allowed, wait = [], []
        for now in rows["at"]:
            if opened is None or now >= opened + seconds:
                opened, n = now, 0
            n += 1
            allowed.append(n <= limit)
            wait.append(0.0 if n <= limit else opened + seconds - now)
        state.update((opened, n))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((opened + seconds) * 1000)))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "allowed": allowed, "retry_after": wait})

    marked = stream.withWatermark(at, delay)
    rows = marked.select(key, at, (F.unix_micros(at).cast("double") / 1e6).alias("__at"), "event_id")
    rows = rows.groupBy(key)
    return rows.applyInPandasWithState(lambda g, b, s: judge(g, (x.assign(at=x["__at"]) for x in b), s), "event_id long, allowed boolean, retry_after double", "opened double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def upserted(stream: DataFrame, keys: list[str], order: str, name: str, base: str | None = None) -> DataFrame:
    """A ledger that holds the last row of each key. A batch writes its own last rows under its number,
    so that one which runs again writes the same; reading merges them. With `base`, a shared folder of
    the caller's, a later start goes on from what was read and kept before."""
    base = base or f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def last(rows: DataFrame) -> DataFrame:
        columns = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*keys, "r.*")

    def keep(rows: DataFrame, batch: int) -> None:
        last(rows).write.mode("overwrite").parquet(f"{base}/rows/part={batch}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return last(stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows/part=*"))


def observed_rules(stream: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """(keys, rules): what was observed of each subject up to now, in whatever order it came. State is
    a set of known rules a subject, so late evidence adds to it and scores are made again from it."""
    known = stream.join(F.broadcast(rules.select("rule_key")), "rule_key")
    return known.groupBy(*keys).agg(F.collect_set("rule_key").alias("rules"))
