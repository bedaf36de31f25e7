"""Key=value logs of system calls, and sessions of a user interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("opens", "reads", "bytes", "closes", "stats", "writes", "write_bytes")
KEYS = {"opens": "opens", "reads": "reads", "bytes": "bytes", "closes": "closes", "stats": "stats", "writes": "writes", "write_bytes": "writeBytes"}
CALLS = ("opens", "reads", "closes", "stats", "writes")
#: Lines of a block, within which a window runs; only a row per block goes through a window over a whole file.
BLOCK = 1 << 14
_PAIR = r'([^\s=]+)=("(?:[^"\\]|\\.)*"|\S*)'


def parse(lines: DataFrame) -> DataFrame:
    """lines (value, ...) with `kv`, a map of their keys and values; of a repeated key the last value counts."""
    own = lines.where("trim(value) <> ''").withColumn("__all", F.regexp_extract_all("value", F.lit(_PAIR), F.lit(0)))
    key = lambda x: F.substring_index(x, "=", 1)
    value = lambda x: F.substring(x, F.length(key(x)) + 2, F.length(x))
    plain = lambda v: F.when(F.startswith(v, F.lit('"')), F.when(F.contains(v, F.lit("\\")), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(v)
    own = own.withColumn("__k", F.transform("__all", key)).withColumn("__v", F.transform("__all", lambda x: plain(value(x))))
    pairs = F.arrays_zip(F.col("__k").alias("k"), F.col("__v").alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice("__k", i + 2, F.greatest(F.lit(0), F.size("__k"))), lambda k: k == x["k"]))
    every = F.when(F.size(F.array_distinct("__k")) == F.size("__k"), pairs).otherwise(last)
    return own.withColumn("kv", F.map_from_entries(every)).drop("__all", "__k", "__v")


def _at(key: str) -> Column:
    return F.col("kv")[key]


def _time() -> Column:
    return F.unix_timestamp(F.try_to_timestamp(_at("t"), F.lit("yyyy-MM-dd'T'HH:mm:ssZ")))


def named(parsed: DataFrame) -> DataFrame:
    """Lines about system calls and error lines (bad), with the file they are of and the host they name, if any.

    An event is of the file it names (its last component), else of its log; an error is of its log. Row by row, so of
    streams too."""
    bad = F.coalesce(_at("lvl"), F.lit("")) == "eror"
    own = parsed.where(bad | _at("msg").isNull() | _at("msg").isin("syscalls", "syscall logging"))
    told = F.nullif(F.regexp_extract(F.coalesce(_at("file"), F.lit("")), "([^/]+)/*$", 1), F.lit(""))
    file = F.when(bad, F.col("file")).otherwise(F.coalesce(told, F.col("file")))
    host = F.when(~bad & (_at("host") != ""), _at("host"))
    return own.select("run", F.col("file").alias("log"), file.alias("file"), "line_no", "kv", bad.alias("bad"), host.alias("host"))


def _routed(parsed: DataFrame) -> DataFrame:
    return fill_host(named(parsed))


def fill_host(rows: DataFrame) -> DataFrame:
    """A host holds for its file until an event names another; logs are read one after the other.

    A file's lines are dealt out in blocks: each block's last host is carried over the blocks, then within each block,
    so that one huge log is many tasks."""
    keys, order = ["run", "file"], ["log", "block"]
    own = rows.withColumn("block", F.floor(F.col("line_no") / BLOCK))
    last = F.max(F.when(F.col("host").isNotNull(), F.struct("line_no", "host")))["host"]
    blocks = own.groupBy(*keys, *order).agg(last.alias("last"))
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, *order, F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy(*keys, *order).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = own.join(carried, [*keys, *order]).withColumn("host", F.coalesce(F.last("host", ignorenulls=True).over(inside), "carried"))
    return out.select(*rows.columns)


def counted(routed: DataFrame) -> DataFrame:
    """(run, file, line_no, time, host, counters) of routed lines that aren't errors."""
    return routed.where("NOT bad").select("run", "file", "line_no", _time().alias("time"), "host", *[F.expr(f"try_cast(kv['{KEYS[c]}'] AS bigint)").alias(c) for c in COUNTERS])


def events(parsed: DataFrame) -> DataFrame:
    """(run, file, line_no, time, host, counters) of lines about system calls that aren't errors."""
    return counted(_routed(parsed))


def errors(parsed: DataFrame) -> DataFrame:
    """(run, file, line_no, time, host, message, data) of error lines; data holds all other keys."""
    return _routed(parsed).where("bad").select("run", "file", "line_no", _time().alias("time"), "host", _at("msg").alias("message"), F.map_filter("kv", lambda k, v: ~k.isin("t", "lvl", "msg")).alias("data"))


def job_timeouts(jobs: DataFrame) -> DataFrame:
    """An error for each job that began and never ended."""
    return jobs.where("start_time IS NOT NULL AND end_time IS NULL").select(F.col("start_time").alias("time"), F.concat(F.lit("Timeout: "), "id").alias("message"), "host")


def run_totals(ev: DataFrame, err: DataFrame) -> DataFrame:
    """Per run: sums, calls (without writes), begin and end, errors, and whether it is complete."""
    sums = ev.groupBy("run").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], F.min("time").alias("start"), F.max("time").alias("end"))
    bad = err.groupBy("run").agg(F.count("*").alias("errors"))
    out = sums.join(bad, "run", "full").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return out.withColumn("calls", F.col("opens") + F.col("reads") + F.col("closes") + F.col("stats")).withColumn("complete", F.col("errors") == 0)


def by_minute(ev: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Events summed up by file and minute: each counter, and those of the minute's first event alone (first, at).

    Such sums of parts of the events merge (merged_minutes), so a stream can keep them batch by batch."""
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in COUNTERS}
    own = ev.where("time IS NOT NULL").select(*keys, "file", F.floor(F.col("time") / 60).alias("minute"), F.struct("time", "line_no").alias("at"), *[v.alias(c) for c, v in counts.items()])
    return own.groupBy(*keys, "file", "minute").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.min_by(F.struct(*COUNTERS), "at").alias("first"), F.min("at").alias("at"), F.count("*").alias("events"))


def merged_minutes(parts: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """by_minute of the whole from by_minute of its parts."""
    return parts.groupBy(*keys, "file", "minute").agg(*[F.sum(c).alias(c) for c in (*COUNTERS, "events")], F.min_by("first", "at").alias("first"), F.min("at").alias("at"))


def spread(minutes: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """(keys, minute, calls, counters) from by_minute, zero-filled: a minute's first event is spread evenly over the
    minutes since its file's previous one, all others are of their own minute. The window over a file has a row per
    minute, however many lines it has."""
    before = F.lag("minute").over(Window.partitionBy(*keys, "file").orderBy("minute"))
    own = minutes.withColumn("from", F.coalesce(before + 1, "minute"))
    each = own.select("*", F.explode(F.sequence("from", "minute")).alias("m"))
    part = lambda c: F.col(f"first.{c}") / (F.col("minute") - F.col("from") + 1) + F.when(F.col("m") == F.col("minute"), F.col(c) - F.col(f"first.{c}")).otherwise(0)
    sums = each.select(*keys, F.col("m").alias("minute"), *[part(c).alias(c) for c in COUNTERS]).groupBy(*keys, "minute").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return filled(sums, keys)


def filled(sums: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Sums by minute with the minutes between that have none, and the rate of all calls."""
    ends = sums.groupBy(*keys).agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    # days are dealt out before their minutes, so that one odd time doesn't make all rows in one task
    days = ends.select(*keys, "a", "b", F.explode(F.sequence(F.floor(F.col("a") / 1440), F.floor(F.col("b") / 1440))).alias("day")).repartition(*keys, "day")
    every = days.select(*keys, F.explode(F.sequence(F.greatest("a", F.col("day") * 1440), F.least("b", F.col("day") * 1440 + 1439))).alias("minute"))
    own = sums.select(*[F.col(c).alias(f"__{c}") for c in (*keys, "minute")], *COUNTERS)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]  # a host may be unknown
    out = every.join(own, [F.col("minute") == F.col("__minute"), *same], "left").select(*keys, "minute", *COUNTERS).fillna(0.0, list(COUNTERS))
    return out.withColumn("calls", sum((F.col(c) for c in CALLS[1:]), F.col(CALLS[0])))


def minute_rates(ev: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Each counter's rate in each minute of a run (or of a run's host, with keys run and host), and that of all calls.

    What an event counts is spread evenly over the minutes since its file's previous event, at least one; minutes
    between without calls are 0."""
    return spread(by_minute(ev, keys), keys)


def rate_maxima(rates: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """The most calls, and the most bytes read or written, in a minute, rounded up; 0 of nothing."""
    most = rates.groupBy(*keys).agg(F.max("calls").alias("calls"), F.max(F.greatest("bytes", "write_bytes")).alias("bytes"))
    return most.select(*keys, *[F.when(F.col(c) > 0, rounded_up(F.col(c))).otherwise(0.0).alias(c) for c in ("calls", "bytes")])


def rounded_up(n: Column) -> Column:
    """To a tenth of its power of ten."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(n)))
    return F.ceil(10 * n / p) * p / 10


def error_preview(err: DataFrame, most: int = 7, ends: int = 3) -> DataFrame:
    """All errors of a run, or the first and last three of more than seven."""
    w, order = Window.partitionBy("run"), ("time", "file", "line_no")
    n = err.groupBy("run").agg(F.count("*").alias("n"))
    # ranks with a limit: each task keeps its first and last few rows before the shuffle
    head = err.withColumn("i", F.row_number().over(w.orderBy(*order))).where(F.col("i") <= most).join(n, "run").where((F.col("n") <= most) | (F.col("i") <= ends))
    tail = err.withColumn("i", F.row_number().over(w.orderBy(*map(F.desc, order)))).where(F.col("i") <= ends).join(n, "run").where(F.col("n") > most)
    return head.unionByName(tail.withColumn("i", (F.col("n") - F.col("i") + 1).cast("int"))).drop("n")


# ---- user interface ----

def mode(state: Column) -> Column:
    """byUser: users; just: disktree; else groups."""
    return F.when(F.get_json_object(state, "$.byUser") == "true", "users").when(F.get_json_object(state, "$.just").isNotNull(), "disktree").otherwise("groups")


def clean_state(state: Column) -> Column:
    """The state with keys whose values parse as their type should; unknown keys stay as strings."""
    raw = F.from_json(state, "map<string,string>")
    ints, lists, bools = ["age", "sinceAccess", "minSize", "maxSize"], ["groups", "users"], ["byUser", "useMTime", "useCount", "viewList"]
    ok = F.map_filter(raw, lambda k, v: F.when(k.isin(*ints), v.rlike(r"^-?\d+$")).when(k.isin(*lists), v.rlike(r"^\[\s*(-?\d+\s*(,\s*-?\d+\s*)*)?\]$")).when(k.isin(*bools), v.isin("true", "false")).otherwise(True))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(ok))))


def sessions(ui: DataFrame) -> DataFrame:
    m = mode(F.col("state"))
    return ui.groupBy("user", F.substring("session", 1, 14).alias("session")).agg(*[F.count_if(m == k).alias(k) for k in ("groups", "users", "disktree")], F.min("time").alias("start"), F.max("time").alias("end"))


def users(s: DataFrame) -> DataFrame:
    return s.groupBy("user").agg(F.count("*").alias("sessions"), *[F.count_if(F.col(k) > 0).alias(k) for k in ("groups", "users", "disktree")])


def top(u: DataFrame) -> DataFrame:
    return u.agg(F.count("*").alias("n"), *[F.count_if(F.col(k) > 0).alias(k) for k in ("groups", "users", "disktree")])


def nested(ui: DataFrame) -> DataFrame:
    """Events by user, session and time: rows in that order over all partitions, so a session may be of any size."""
    order = ("user", "session", "time", "state")
    return ui.repartitionByRange(*order).sortWithinPartitions(*order)
