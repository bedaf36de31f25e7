"""Lookups by longest prefix, base-directory usage with owners and quotas, history and forecasts.

Dimension tables (mounts, quotas, owners, rules) are joined on candidate prefixes, which is an equi-join; Spark broadcasts
what is below its threshold of bytes, by the files' sizes or as it is measured at run time, and shuffles the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlens.functions import paths

YEAR = 365 * 86400


def _prefixes(path: Column) -> Column:
    """Every directory a path lies in, the path itself if it is one."""
    return paths.ancestors(F.regexp_replace(path, "[^/]+$", ""))


def mount_of_path(rows: DataFrame, mounts: DataFrame, column: str) -> DataFrame:
    """rows with `mount`, the longest mount that their path lies in, or ''.

    Looked up once per directory, by equality with each of its prefixes."""
    own = rows.withColumn("__dir", F.regexp_replace(F.col(column), "[^/]+$", ""))
    dirs = own.select("__dir").distinct()
    met = dirs.select("__dir", F.explode(_prefixes(F.col("__dir"))).alias("mount")).join(mounts.select("mount").distinct(), "mount")
    best = met.groupBy("__dir").agg(F.max_by("mount", F.length("mount")).alias("mount"))
    return own.join(best, "__dir", "left").withColumn("mount", F.coalesce("mount", F.lit(""))).drop("__dir")


def quota_for_dir(rows: DataFrame, quotas: DataFrame, column: str = "basedir") -> DataFrame:
    """rows (gid, path) with the quotas of the first table row of their gid whose disk the path lies in; else 0."""
    keys = rows.select("gid", F.col(column).alias("__p")).distinct()
    met = keys.select("gid", "__p", F.explode(_prefixes(F.col("__p"))).alias("disk")).join(quotas, ["gid", "disk"])
    best = met.groupBy("gid", "__p").agg(F.min_by(F.struct("size_quota", "inode_quota"), "ordinal").alias("q"))
    out = rows.withColumn("__p", F.col(column)).join(best, ["gid", "__p"], "left")
    zero = F.lit(0).cast("long")
    return out.withColumn("quota_size", F.coalesce("q.size_quota", zero)).withColumn("quota_inodes", F.coalesce("q.inode_quota", zero)).drop("q", "__p")


def with_owner(rows: DataFrame, owners: DataFrame) -> DataFrame:
    return rows.join(owners.groupBy("gid").agg(F.max("owner").alias("owner")), "gid", "left").withColumn("owner", F.coalesce("owner", F.lit("")))


def with_names(rows: DataFrame, names: DataFrame, id_col: str, out: str, unknown: str = "id") -> DataFrame:
    """rows with a name for an id (names: id, name); unknown ids get the prefix and the number."""
    n = names.select(F.col("id").alias(id_col), F.col("name").alias(out))
    return rows.join(n, id_col, "left").withColumn(out, F.coalesce(out, F.concat(F.lit(unknown), F.col(id_col).cast("string"))))


def with_name_lists(rows: DataFrame, names: DataFrame, key: str, ids: str, out: str) -> DataFrame:
    """rows (one of each key) with a sorted list of the names (id, name) of a list of ids; ids without a name are left out."""
    each = rows.select(key, F.explode(ids).alias("id")).join(names, "id").groupBy(key).agg(F.array_sort(F.collect_set("name")).alias(out))
    return rows.join(each, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def usage_order(by: str, reverse: bool = False) -> list[Column]:
    """Order by a column of a usage table, or by percent_size or percent_inodes of the quota (without one: before all
    others, and after them if reversed); of equals by base directory, which keeps its direction."""
    kinds = {"percent_size": "size", "percent_inodes": "inodes"}
    value = F.expr(f"try_divide(usage_{kinds[by]}, quota_{kinds[by]})") if by in kinds else F.col(by)
    return [value.desc_nulls_last() if reverse else value.asc_nulls_first(), F.col("basedir"), F.col("gid")]


def usage_page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """A page of rows in an order, with their place; the last page if there are fewer."""
    last = max(0, (rows.count() - 1) // size)
    number = min(max(number, 0), last)
    page = rows.orderBy(*order).offset(number * size).limit(size)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long") + number * size)  # of one page


def names_in_use(rows: DataFrame, column: str) -> DataFrame:
    """The names of a column, once each, for a picker; empty ones are left out."""
    return rows.where(F.col(column) != "").select(column).distinct()


# ---- history ----

def one_per_date(points: DataFrame) -> DataFrame:
    """Points of which a series has one for each date: of several the one of the greatest usage, then quota, then of
    the greatest other columns, in their order."""
    key, names = ["gid", "mount_path", "date"], ["usage_size", "usage_inodes", "quota_size", "quota_inodes"]
    rest = [c for c in names if c in points.columns] + [c for c in points.columns if c not in (*key, *names)]
    if not rest:
        return points.dropDuplicates(key)
    return points.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__x")).select(*key, "__x.*").select(*points.columns)


def history_append(history: DataFrame, points: DataFrame) -> DataFrame:
    """history and those points that come after their series' last date."""
    last = history.groupBy("gid", "mount_path").agg(F.max("date").alias("last"))
    new = points.join(last, ["gid", "mount_path"], "left").where("last IS NULL OR date > last").select(*history.columns)
    return history.unionByName(new)


def history_seed(history: DataFrame, previous: DataFrame) -> DataFrame:
    return history.unionByName(previous).distinct()


def history_invalid(history: DataFrame, prefix: str) -> DataFrame:
    """Series whose mount doesn't begin with the prefix."""
    return history.where(~F.startswith("mount_path", F.lit(prefix))).select("gid", "mount_path").distinct()


def history_counts(history: DataFrame) -> DataFrame:
    """How many series and points there are."""
    return history.agg(F.count_distinct("gid", "mount_path").alias("histories"), F.count("*").alias("points"))


def history_clean(history: DataFrame, prefix: str) -> DataFrame:
    return history.where(F.startswith("mount_path", F.lit(prefix)))


def history_of(history: DataFrame, gid: int, path: str) -> DataFrame:
    """The series of a group on the mount that the path lies in, the longest of several; none is an error."""
    own = history.where((F.col("gid") == gid) & F.startswith(F.lit(path), F.col("mount_path")))
    if own.isEmpty():
        raise ValueError(f"no history of group {gid} at {path}")
    longest = own.agg(F.max(F.length("mount_path")).alias("n"))
    return own.join(F.broadcast(longest), F.length("mount_path") == F.col("n"), "left_semi").orderBy("date")  # one row


def _line(history: DataFrame) -> DataFrame:
    """The latest point of each series, and the third last (the first of fewer)."""
    w = Window.partitionBy("gid", "mount_path").orderBy("date")
    back = lambda c: F.coalesce(F.lag(c, 2).over(w), F.first(c).over(w))
    out = history.select("*", *[back(c).alias(f"old_{c}") for c in ("date", "usage_size", "usage_inodes")], F.first("date").over(w).alias("first_date"), F.lead("date").over(w).alias("later"))
    return out.where("later IS NULL")


def quota_forecast(history: DataFrame, ref_time: int, years: int = 5) -> DataFrame:
    """When size and inode quotas will be used up: epoch seconds, null if never or more than `years` ahead."""

    def when(kind: str) -> Column:
        used, quota, old = F.col(f"usage_{kind}").cast("double"), F.col(f"quota_{kind}").cast("double"), F.col(f"old_usage_{kind}").cast("double")
        span = (F.col("date") - F.col("old_date")).cast("double")
        full = F.floor(F.col("date") + (quota - used) * span / (used - old)).cast("long")
        ahead = F.when((used > old) & (span > 0), full)
        return F.when(used >= quota, F.col("date")).otherwise(F.when(ahead <= ref_time + years * YEAR, ahead))

    return _line(history).select("gid", "mount_path", "date", when("size").alias("date_no_space"), when("inodes").alias("date_no_files"))


def usage_forecast(usage: DataFrame, history: DataFrame, ref_time: int) -> DataFrame:
    """Group usage of age 0 with the forecast of the series whose mount its base directory lies in."""
    keys = usage.where("age = 0").select("gid", "basedir").distinct()
    met = keys.select("gid", "basedir", F.explode(_prefixes(F.col("basedir"))).alias("mount_path")).join(quota_forecast(history, ref_time), ["gid", "mount_path"])
    best = met.groupBy("gid", "basedir").agg(F.max_by(F.struct("date_no_space", "date_no_files"), F.length("mount_path")).alias("f"))
    return usage.where("age = 0").join(best, ["gid", "basedir"], "left").select(*usage.columns, "f.date_no_space", "f.date_no_files")


def days_left(date: Column, ref_time: int) -> Column:
    return F.round(date / 86400).cast("long") - F.lit(ref_time // 86400)


def usage_projection(history: DataFrame, kind: str = "size") -> DataFrame:
    """The forecast's line one fifth of the series' span past its latest date, between 0 and the quota."""
    used, quota, old = F.col(f"usage_{kind}").cast("double"), F.col(f"quota_{kind}").cast("double"), F.col(f"old_usage_{kind}").cast("double")
    slope = F.when(F.col("date") > F.col("old_date"), (used - old) / (F.col("date") - F.col("old_date"))).otherwise(0.0)
    end = F.col("date") + (F.col("date") - F.col("first_date")) / 5
    value = used + slope * (end - F.col("date"))
    at = F.when(value > quota, F.col("date") + (quota - used) / slope).when(value < 0, F.col("date") - used / slope).otherwise(end)
    return _line(history).where(used < quota).select("gid", "mount_path", F.floor(at).cast("long").alias("date"), F.floor(F.least(quota, F.greatest(F.lit(0.0), value))).cast("long").alias("value"))
