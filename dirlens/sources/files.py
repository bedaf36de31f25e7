"""Readers and writers of the text formats: file listings, dimension files, logs, jobs, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlens.functions import filetypes, formats, paths
from dirlens.operators.usage import one_per_date

STATS = "path string, size long, uid long, gid long, atime long, mtime long, ctime long, entry_type string, inode long, nlink long, device long, apparent_size long"
_COLUMNS = [c.split()[0] for c in STATS.split(", ")]
SUBTREE = 4


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir; below /tmp/checkpoints where that is unset,
    which only a local session may do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def scan_stats(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A file listing: 12 tab-separated columns, the path in double quotes; gzip is read too, but can't be split, so
    `partitions` deals its rows out. Blank lines are skipped, lines of fewer columns are an error; a path that ends in
    / is a directory. `source` is the file a row came from."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source")).where("trim(value) <> ''")
    lines = lines.repartition(partitions) if partitions else lines
    cells = lines.withColumn("c", F.split("value", "\t"))
    cells = cells.withColumn("c", F.when(F.size("c") >= len(_COLUMNS), F.col("c")).otherwise(F.raise_error(F.concat(F.lit("too few columns: "), F.col("value"))).cast("array<string>")))
    out = cells.select(*[(paths.unquote(F.col("c")[0]) if i == 0 else F.col("c")[i].cast(t)).alias(n) for i, (n, t) in enumerate(x.split() for x in STATS.split(", "))], "source")
    return out.withColumn("entry_type", F.when(F.endswith("path", F.lit("/")), "d").otherwise(F.col("entry_type")))


def write_stats(stats: DataFrame, path: str, compression: str = "gzip") -> None:
    quoted = F.concat(F.lit('"'), F.replace(F.replace("path", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    stats.select(F.concat_ws("\t", quoted, *[F.col(c).cast("string") for c in _COLUMNS[1:]]).alias("value")).write.option("compression", compression).text(path)


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV without a header that must have just these columns; `ordinal` sorts by file, by split, then by line."""
    n = len(schema.split(","))
    ordinal = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", ordinal.alias("ordinal")).where("trim(value) <> ''")
    cells = lines.withColumn("c", F.split("value", ",", -1))
    cells = cells.withColumn("c", F.when(F.size("c") == n, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("wrong number of columns: "), F.col("value"))).cast("array<string>")))
    return cells.select(*[F.trim(F.col("c")[i]).cast(t).alias(k) for i, (k, t) in enumerate(x.split() for x in schema.split(", "))], "ordinal")


def load_quotas(spark: SparkSession, path: str) -> DataFrame:
    return load_csv(spark, path, "gid long, disk string, size_quota long, inode_quota long").withColumn("disk", paths.normalise(F.col("disk")))


def load_owners(spark: SparkSession, path: str) -> DataFrame:
    """The last line of a group counts."""
    return load_csv(spark, path, "gid long, owner string").groupBy("gid").agg(F.max_by("owner", "ordinal").alias("owner"))


def load_areas(spark: SparkSession, path: str) -> DataFrame:
    return load_csv(spark, path, "group_name string, area string").groupBy("area").agg(F.array_sort(F.collect_set("group_name")).alias("groups"))


def load_mounts(spark: SparkSession, path: str) -> DataFrame:
    """One quoted path per line."""
    own = F.trim(F.regexp_replace("value", '"', ""))
    return spark.read.text(path).where(own != "").select(paths.normalise(own).alias("mount")).distinct()


def load_basedir_config(spark: SparkSession, path: str) -> DataFrame:
    """PREFIX, SPLITS and MINDIRS by tabs; comments begin with #."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')").withColumn("c", F.split("value", "\t"))
    c = F.when(F.size("c") == 3, F.col("c")).otherwise(F.raise_error(F.lit("a rule needs three columns")).cast("array<string>"))
    return lines.withColumn("c", c).select(F.col("c")[0].alias("prefix"), F.col("c")[1].cast("int").alias("splits"), F.col("c")[2].cast("int").alias("mindirs"))


def write_lines(rows: DataFrame, order: list, columns: list, path: str, compression: str = "none") -> None:
    """Tab-separated lines in order."""
    rows.orderBy(*order).select(F.concat_ws("\t", *columns).alias("value")).write.option("compression", compression).text(path)


def write_dupes(sets: DataFrame, path: str) -> None:
    """Each size with its sets of links (apparent_size, paths): their first paths in quotes, the others after a tab."""
    own = sets.select("apparent_size", F.col("paths")[0].alias("first"), F.posexplode("paths").alias("i", "path"))
    body = own.select("apparent_size", F.lit(1).alias("part"), "first", "i", F.concat(F.when(F.col("i") > 0, "\t").otherwise(""), F.lit('"'), "path", F.lit('"')).alias("line"))
    head = sets.select("apparent_size").distinct().select("apparent_size", F.lit(0).alias("part"), F.lit("").alias("first"), F.lit(0).alias("i"), F.concat(F.lit("Size: "), "apparent_size").alias("line"))
    write_lines(head.union(body), ["apparent_size", "part", "first", "i"], ["line"], path)


def write_groups_csv(rows: DataFrame, path: str) -> None:
    """Group usage (owner, name, basedir, usage and quotas, mtime, status) with a header; quotes are doubled."""
    told = {"PI": "owner", "Group": "name", "Path": "basedir", "Space": "usage_size", "SQuota": "quota_size", "Inodes": "usage_inodes", "IQuota": "quota_inodes"}
    rows.select(*[F.col(c).alias(k) for k, c in told.items()], formats.iso_time(F.col("mtime")).alias("LastMod"), F.col("status").alias("Status")).write.option("header", True).option("escape", '"').csv(path)


def write_users_csv(rows: DataFrame, path: str) -> None:
    """User usage (name, basedir, usage_size, usage_inodes, mtime) with a header; quotes are doubled."""
    told = {"User": "name", "Path": "basedir", "Space": "usage_size", "Inodes": "usage_inodes"}
    rows.select(*[F.col(c).alias(k) for k, c in told.items()], formats.iso_time(F.col("mtime")).alias("LastMod")).write.option("header", True).option("escape", '"').csv(path)


def write_summaries_json(rows: DataFrame, path: str, age: int = 0) -> None:
    """A JSON object per directory summary, with lists of names (users, groups) in place of ids."""
    types = F.array_sort(F.split(filetypes.mask_names(F.col("ft")), r"\|"))
    told = F.struct(F.col("dir").alias("Dir"), F.col("count").alias("Count"), F.col("size").alias("Size"), formats.iso_time(F.col("atime")).alias("Atime"), formats.iso_time(F.col("mtime")).alias("Mtime"), F.col("users").alias("Users"), F.col("groups").alias("Groups"), types.alias("FileTypes"), F.lit(age).alias("Age"))
    rows.select(F.to_json(told).alias("value")).write.text(path)


def log_lines(lines: DataFrame) -> DataFrame:
    """Lines of text, read with their file's path as `source`, with `run`, its folder's name, and `file`, its own
    without its ending; logs.gz is the walk's log."""
    name = F.element_at(F.split("source", "/"), -1)
    file = F.when(name == "logs.gz", "walk").otherwise(F.regexp_replace(name, r"\.log$", ""))
    return lines.select(F.element_at(F.split("source", "/"), -2).alias("run"), file.alias("file"), "value")


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run, file, value) of all lines of the log files below a folder of runs."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return log_lines(lines.select("value", F.url_decode("_metadata.file_path").alias("source")))


def write_dguta(cube: DataFrame, path: str, updated_at: Column) -> None:
    """A partition per mount_path (absolute, with a slash at its end), with the time its data is of; only those present
    are replaced. A mount has rows of the directories above it too, which readers merge over the mounts.

    Rows are dealt out by mount and the first SUBTREE components of their directory, and lie in order in each file: a
    subtree is a run of few files, readers skip the others' row groups, and Spark splits what is too large for a task.
    No ranges are sampled, which would compute the cube twice."""
    ok = F.startswith("mount_path", F.lit("/")) & F.endswith("mount_path", F.lit("/"))
    mount = F.when(ok, F.col("mount_path")).otherwise(F.raise_error(F.concat(F.lit("not a mount path: "), F.col("mount_path"))).cast("string"))
    rows = cube.withColumn("updated_at", updated_at.cast("long")).withColumn("mount_path", mount)
    subtree = F.regexp_extract("dir", rf"^((?:/[^/]*){{0,{SUBTREE}}})", 1)
    dealt = rows.withColumn("__subtree", subtree).hint("rebalance", "mount_path", "__subtree").drop("__subtree")
    dealt.sortWithinPartitions("mount_path", "dir").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mount_path").parquet(path)


def union_sources(spark: SparkSession, path: str, mount: str | None = None, directory: str | None = None) -> DataFrame:
    """All mounts as one, or one mount's partition alone, or what lies at or below a directory. A directory above
    several mounts has rows of each; sums over them (dir_summary, merge_cubes) tell it as one."""
    every = spark.read.parquet(path)
    every = every if mount is None else every.where(F.col("mount_path") == mount)
    return every if directory is None else every.where(F.startswith("dir", F.lit(directory)))


def mount_timestamps(cube: DataFrame) -> DataFrame:
    """(mount_path, updated_at) of a stored cube; of several sources of a mount the latest."""
    return cube.groupBy("mount_path").agg(F.max("updated_at").alias("updated_at"))


def top_timestamps(cube: DataFrame) -> DataFrame:
    """(top, updated_at): the latest time of each first component of the mounts."""
    top = F.regexp_extract("mount_path", "^/([^/]*)", 1).alias("top")
    return mount_timestamps(cube).groupBy(top).agg(F.max("updated_at").alias("updated_at"))


def write_basedirs(path: str, usage: DataFrame, subdirs: DataFrame, history: DataFrame) -> None:
    """Three tables of base directories by mount_path: usage and subdirs of the mounts present are replaced, points of
    history that come after their series' last date are added, one for each date."""
    for name, rows in (("usage", usage), ("subdirs", subdirs)):
        rows.hint("rebalance", "mount_path", "kind", "age").sortWithinPartitions("mount_path", "kind", "age", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mount_path", "kind").parquet(f"{path}/{name}")
    spark = history.sparkSession
    history.limit(0).write.mode("append").parquet(f"{path}/history")
    last = spark.read.schema(history.schema).parquet(f"{path}/history").groupBy("gid", "mount_path").agg(F.max("date").alias("last"))
    new = one_per_date(history).join(last, ["gid", "mount_path"], "left").where("last IS NULL OR date > last").select(*history.columns)
    new.write.mode("append").parquet(f"{path}/history")


def intake(events: DataFrame) -> DataFrame:
    """Events with their session's first 14 bytes; those without a session are turned away."""
    cut = F.make_valid_utf8(F.substring(F.col("session").cast("binary"), 1, 14).cast("string"))
    return events.where(F.col("session") != "").withColumn("session", cut)


def append_ui_events(events: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Adds events (user, session, state, time in epoch seconds) to a table with a partition per UTC day.

    A batch's rows have folders of their own in their days, so one that is written again takes its own place; a batch
    without a name is always a new one."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("time") / 86400).cast("int"))
    rows = intake(events).withColumn("date", day).withColumn("batch", F.lit(str(uuid.uuid4().hex if batch is None else batch)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)


def scan_ui_events(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The table's events, or those from one time to another, for which other days aren't read."""
    if first is not None and last is not None and first > last:
        raise ValueError("a time range must not end before it starts")
    day = lambda t: F.date_add(F.lit("1970-01-01").cast("date"), t // 86400)
    out = spark.read.parquet(path)
    out = out if first is None else out.where((F.col("date") >= day(first)) & (F.col("time") >= first))
    out = out if last is None else out.where((F.col("date") <= day(last)) & (F.col("time") <= last))
    return out.drop("date", "batch")


# ---- datasets ----

def file_system(spark: SparkSession, path: str):
    """The filesystem of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(rows: DataFrame, root: str, name: str) -> None:
    """Writes a dataset beside its root's others and makes it visible at once, by its last step, a rename."""
    hidden = f"{root}/.{name}-{uuid.uuid4().hex}"
    rows.write.parquet(hidden)
    fs, source = file_system(rows.sparkSession, hidden)
    if not fs.rename(source, file_system(rows.sparkSession, f"{root}/{name}")[1]):
        raise OSError(f"{name} could not be published in {root}")


def dataset_names(spark: SparkSession, root: str) -> DataFrame:
    """The names of a root's complete datasets; the folder's listing is all that passes the driver."""
    fs, p = file_system(spark, root)
    names = [(x.getPath().getName(),) for x in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return spark.createDataFrame([x for x in names if not x[0].startswith(".")], "name string")


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The rows of each key's latest dataset, with its name and mount_path."""
    names = [r.name for r in latest_datasets(dataset_names(spark, root)).collect()]
    rows = spark.read.parquet(*[f"{root}/{n}" for n in names]).withColumn("name", F.element_at(F.split(F.url_decode("_metadata.file_path"), "/"), -2))
    return rows.withColumn("mount_path", paths.mount_from_name(F.col("name")))


def drop_superseded(spark: SparkSession, root: str) -> list[str]:
    """Removes the datasets of which a later one is visible; their names."""
    gone = [r.name for r in superseded_datasets(dataset_names(spark, root)).collect()]
    for name in gone:
        fs, p = file_system(spark, f"{root}/{name}")
        fs.delete(p, True)
    return gone


def named_datasets(names: DataFrame) -> DataFrame:
    """Valid names <version>_<key>, with whether the version is a number."""
    ok = names.where(F.col("name").rlike(r"^[^.][^_]*_."))
    out = ok.select("name", F.regexp_extract("name", "^([^_]*)_(.*)$", 1).alias("version"), F.regexp_extract("name", "^([^_]*)_(.*)$", 2).alias("key"))
    return out.withColumn("number", F.expr("try_cast(version AS bigint)"))


def _ranked(names: DataFrame) -> DataFrame:
    best = F.struct(F.col("number").isNotNull(), F.coalesce("number", F.lit(0)), "version")
    return named_datasets(names).withColumn("best", best)


def latest_datasets(names: DataFrame) -> DataFrame:
    """Of each key the highest version: numbers before others, by value; others as text."""
    return _ranked(names).groupBy("key").agg(F.max_by("name", "best").alias("name"))


def superseded_datasets(names: DataFrame) -> DataFrame:
    valid = named_datasets(names)
    return valid.join(latest_datasets(names).select("name"), "name", "left_anti").select("key", "name")


def pending_datasets(names: DataFrame, outputs: DataFrame) -> DataFrame:
    """Latest inputs without an output of that name or a marker .<name>."""
    done = outputs.select(F.regexp_replace("name", r"^\.", "").alias("name"))
    return latest_datasets(names).join(done, "name", "left_anti")


def previous_snapshot(names: DataFrame, outputs: DataFrame) -> DataFrame:
    """For each latest input the latest output of its key."""
    return latest_datasets(names).join(latest_datasets(outputs).withColumnRenamed("name", "previous"), "key")
