"""The same operators on streams: file sources, watermarks, and batches that replace or append."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dirlens.operators import logs, usage


def log_minutes(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Calls per run and minute of a stream of events (run, ts, counters); a minute is told once it is `late` old."""
    calls = sum((F.coalesce(c, F.lit(0)) for c in ("opens", "reads", "closes", "stats", "writes")), F.lit(0))
    return stream.withWatermark("ts", late).groupBy("run", F.window("ts", "1 minute").alias("w")).agg(F.sum(calls).alias("calls"), F.count("*").alias("events")).select("run", F.col("w.start").alias("minute"), "calls", "events")


def ui_sessions(stream: DataFrame) -> DataFrame:
    """Running counts per session."""
    return logs.sessions(stream)


def append_history(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends those points of each batch that come after their series' last date, to path/points.

    Each batch has folders of its own, so one that is repeated replaces its part; the series' last dates are a small
    table that each batch writes anew from the batch before, so the points themselves are not read again."""

    def batch(points: DataFrame, i: int) -> None:
        spark, schema = points.sparkSession, "gid long, mount_path string, last long"
        known = spark.read.schema(schema).parquet(f"{path}/last/{i - 1}") if i else spark.createDataFrame([], schema)
        new = usage.one_per_date(points).join(known, ["gid", "mount_path"], "left").where("last IS NULL OR date > last")
        new.select(*points.columns).write.mode("overwrite").parquet(f"{path}/points/batch={i}")
        added = spark.read.schema(points.schema).parquet(f"{path}/points/batch={i}").select("gid", "mount_path", F.col("date").alias("last"))
        known.unionByName(added).groupBy("gid", "mount_path").agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{path}/last/{i}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_calls(lines: DataFrame) -> DataFrame:
    """(run, ts, counters) of a stream of log lines (run, value) about system calls that aren't errors."""
    kv = logs.parse(lines)
    own = kv.where((F.coalesce(F.col("kv")["lvl"], F.lit("")) != "eror") & (F.col("kv")["msg"].isNull() | F.col("kv")["msg"].isin("syscalls", "syscall logging")))
    ts = F.try_to_timestamp(F.col("kv")["t"], F.lit("yyyy-MM-dd'T'HH:mm:ssZ"))
    return own.select("run", ts.alias("ts"), *[F.expr(f"try_cast(kv['{logs.KEYS[c]}'] AS bigint)").alias(c) for c in ("opens", "reads", "closes", "stats", "writes")])


def run_to_table(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataFrame:
    """All that is there now: partial(rows) of each batch, late rows too, in a Parquet table; a batch that is repeated
    replaces its own part. What has the same key in several batches is still to be merged."""
    schema = partial(stream).schema
    stream.sparkSession.createDataFrame([], schema).write.parquet(f"{path}/batch=-1")

    def batch(rows: DataFrame, i: int) -> None:
        partial(rows).write.mode("overwrite").parquet(f"{path}/batch={i}")

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(path)


def run_log_minutes(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Every minute of all events that are there now, whatever their order."""
    return run_to_table(stream, log_minutes, path, checkpoint).groupBy("run", "minute").agg(F.sum("calls").alias("calls"), F.sum("events").alias("events"))


def run_ui_sessions(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The sessions of all events that are there now."""
    parts = run_to_table(stream, ui_sessions, path, checkpoint)
    return parts.groupBy("user", "session").agg(*[F.sum(k).alias(k) for k in ("groups", "users", "disktree")], F.min("start").alias("start"), F.max("end").alias("end"))



_CARRIED = "run string, file string, line_no long, time long, host string, first_minute long, " + ", ".join(f"{c} long" for c in logs.COUNTERS)


def carried(events: DataFrame, idle: int | None = None) -> DataFrame:
    """A stream of events (run, file, line_no, time, host named or null, counters) with what the lines before say: the
    file's host, and the first of the minutes that an event is spread over (the one after its file's previous event).

    A file's state is its last host and its latest minute, whatever it has of lines. With `idle` (milliseconds) it goes
    when nothing has come for so long; that is for queries that run on, since timers keep a query alive. Lines of a batch may come in any order, a file's batches in order of their lines: an event that is earlier
    than a batch before is of its own minute alone. A batch's events of one file meet in a task, so the trigger bounds them."""

    names, whole = [c.split()[0] for c in _CARRIED.split(", ")], ["line_no", "time", *logs.COUNTERS]

    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        host, minute = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values("line_no", kind="stable")
        rows["host"] = rows["host"].ffill().fillna(host) if host is not None else rows["host"].ffill()
        host = None if pd.isna(rows["host"].iloc[-1]) else rows["host"].iloc[-1]
        timed = rows[rows["time"].notna()].sort_values(["time", "line_no"], kind="stable")
        if len(timed):
            own = (timed["time"] // 60).astype("int64")
            before = own.shift(1)
            before.iloc[0] = float("nan") if minute is None else minute
            timed["first_minute"] = (before + 1).where(before < own, own).astype("int64")
            minute = int(own.iloc[-1]) if minute is None else max(minute, int(own.iloc[-1]))
            timed = timed[names]
            timed[whole] = timed[whole].astype("Int64")
            yield timed
        state.update((host, minute))
        if idle:
            state.setTimeoutDuration(idle)

    keyed = events.select("run", "file", "line_no", "time", "host", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in logs.COUNTERS])
    return keyed.groupBy("run", "file").applyInPandasWithState(one, _CARRIED, "host string, minute long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def log_rates(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps what is counted by run, host and minute of a stream of log lines (run, file, line_no, value), spread as
    minute_rates does, in a folder for each batch below path; a batch that is repeated replaces its own."""
    spread = carried(logs.counted(logs.named(logs.parse(lines))))

    def batch(rows: DataFrame, i: int) -> None:
        n = F.col("time_minute") - F.col("first_minute") + 1
        each = rows.withColumn("time_minute", F.floor(F.col("time") / 60)).select("run", "host", F.explode(F.sequence("first_minute", "time_minute")).alias("minute"), *[(F.col(c) / n).alias(c) for c in logs.COUNTERS])
        each.groupBy("run", "host", "minute").agg(*[F.sum(c).alias(c) for c in logs.COUNTERS]).write.mode("overwrite").parquet(f"{path}/batch={i}")

    return spread.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log_rates(spark, path: str, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """The rates of all batches that are there, by run, or by run and host."""
    parts = spark.read.parquet(path)
    return logs.filled(parts.groupBy(*keys, "minute").agg(*[F.sum(c).alias(c) for c in logs.COUNTERS]), keys)
