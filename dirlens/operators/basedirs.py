"""Base directories: for each group or user, and age, the deepest directory that holds all of its files in a unit.

A unit is the directory at the depth that the longest matching rule names. Files are summed up per directory before
ages are dealt out; the common directory comes from the least and greatest component arrays, so it needs no list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlens.functions import ages, filetypes, paths


def rule_for(dirs: DataFrame, rules: DataFrame, column: str = "dir") -> DataFrame:
    """dirs with `mindirs` of their rule (rules: prefix, mindirs): the one of most components that matches.

    All of a prefix's components but the last must be equal, the last may be the beginning of a name. Rules are few
    (a hand-written file); the join runs over distinct directories on the rule's first components."""
    r = rules.select(paths.parts(F.col("prefix")).alias("rp"), "mindirs")
    r = r.select("mindirs", F.size("rp").alias("n"), F.array_join(F.slice("rp", F.lit(1), F.greatest(F.lit(0), F.size("rp") - 1)), "/").alias("stem"), F.coalesce(F.try_element_at("rp", F.lit(-1)), F.lit("")).alias("last"))
    own = dirs.select(column).distinct().withColumn("p", paths.parts(F.col(column)))
    keyed = own.withColumn("n", F.explode(F.sequence(F.lit(0), F.size("p")))).withColumn("stem", F.array_join(F.slice("p", F.lit(1), F.greatest(F.lit(0), F.col("n") - 1)), "/"))
    met = keyed.join(r, ["n", "stem"]).where((F.col("n") == 0) | F.startswith(F.try_element_at("p", F.col("n")), F.col("last")))
    best = met.groupBy(column).agg(F.max_by("mindirs", F.struct("n", F.length("last"))).alias("mindirs"))
    return dirs.join(best, column)


def unit_files(stats: DataFrame, rules: DataFrame, ref_time: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Files summed up by owner, directory, type and levels, with the unit of each; of links in a directory the first.

    `keep`, if given, stores the sums before they meet their units, which are told from them then, not from stats."""
    files = stats.where("entry_type <> 'd'").withColumn("dir", paths.parent(F.col("path"), F.col("entry_type")))
    # names stand for paths: within a directory they sort alike, and rows are dealt out with them once
    link, name = F.when((F.col("nlink") > 1) & (F.col("inode") != 0), F.col("inode")), paths.basename(F.col("path"))
    once = files.groupBy("dir", link.alias("link"), F.when(link.isNull(), name).alias("alone")).agg(F.min(F.struct(name.alias("name"), "size", "gid", "uid", "atime", "mtime")).alias("f")).select("dir", "f.*")
    typed = once.withColumn("ft", filetypes.typed(F.col("name"), F.col("dir"))).withColumn("a_level", ages.level(F.col("atime"), ref_time)).withColumn("m_level", ages.level(F.col("mtime"), ref_time))
    leaf = typed.groupBy("gid", "uid", "dir", "ft", "a_level", "m_level").agg(F.count("*").alias("count"), F.sum("size").alias("size"), F.min("atime").alias("atime"), F.max("mtime").alias("mtime"))
    leaf = keep(leaf) if keep else leaf
    # a unit is an ancestor whose own rule asks for its depth
    units = (leaf if keep else files).select("dir").distinct().select("dir", F.explode(paths.ancestors(F.col("dir"))).alias("unit"))
    chosen = rule_for(units.select("unit").distinct(), rules, "unit").where(paths.depth(F.col("unit")) == F.col("mindirs")).select("unit")
    return leaf.join(units.join(chosen, "unit"), "dir")


def _aged(leaf: DataFrame) -> DataFrame:
    return leaf.withColumn("age", F.explode(ages.codes(F.col("a_level"), F.col("m_level"))))


def _common(low: Column, high: Column) -> Column:
    """The directory two component arrays share."""
    n = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.size(low), F.size(high))), lambda i: F.slice(low, F.lit(1), i) == F.slice(high, F.lit(1), i)))
    return F.when(n == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(low, F.lit(1), n), "/"), F.lit("/")))


def basedirs(leaf: DataFrame, kind: str) -> DataFrame:
    """(id, age, unit, basedir, count, size, atime, mtime, ft, others) of gid or uid; others: ids of the other kind."""
    other = "uid" if kind == "gid" else "gid"
    parts = paths.parts(F.col("dir"))
    first = leaf.groupBy(F.col(kind).alias("id"), "unit", "a_level", "m_level").agg(F.min(parts).alias("low"), F.max(parts).alias("high"), F.sum("count").alias("count"), F.sum("size").alias("size"), F.min("atime").alias("atime"), F.max("mtime").alias("mtime"), F.bit_or("ft").alias("ft"), F.collect_set(other).alias("o"))
    out = _aged(first).groupBy("id", "age", "unit").agg(F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("count", "size")], F.min("atime").alias("atime"), F.max("mtime").alias("mtime"), F.bit_or("ft").alias("ft"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("o")))).alias("others"))
    return out.withColumn("basedir", _common(F.col("low"), F.col("high"))).select("id", "age", "unit", "basedir", "count", "size", "atime", "mtime", "ft", "others")


def _below(leaf: DataFrame, bases: DataFrame, kind: str) -> DataFrame:
    """Leaf rows at each of their ages, with the base directory of it and their place below that.

    The base directories of an owner and unit are a row of at most 17, so leaf rows are joined before ages multiply them."""
    each = bases.groupBy("id", "unit").agg(F.map_from_entries(F.collect_list(F.struct("age", F.struct("basedir", F.col("mtime").alias("base_mtime"))))).alias("at"))
    own = leaf.select(F.col(kind).alias("id"), "unit", "dir", "ft", "a_level", "m_level", F.col("count").alias("n"), F.col("size").alias("bytes"), F.col("mtime").alias("m"))
    met = _aged(own.join(each, ["id", "unit"])).withColumn("b", F.col("at")[F.col("age")]).select("id", "dir", "ft", "age", "n", "bytes", "m", "b.*")
    rest = F.substring(F.col("dir"), F.length("basedir") + 1, F.length("dir"))
    return met.withColumn("sub", F.when(F.col("dir") == F.col("basedir"), ".").otherwise(F.regexp_extract(rest, "^([^/]+)", 1)))


def subdirs(leaf: DataFrame, bases: DataFrame, kind: str) -> DataFrame:
    """(id, age, basedir, sub, count, size, mtime): files by the base directory's children; '.' are its own."""
    out = _below(leaf, bases, kind).groupBy("id", "age", "basedir", "sub").agg(F.sum("n").alias("count"), F.sum("bytes").alias("size"), F.max(F.when(F.col("sub") == ".", F.col("base_mtime")).otherwise(F.col("m"))).alias("mtime"))
    return out


def usage_by_type(leaf: DataFrame, bases: DataFrame, kind: str) -> DataFrame:
    """(id, age, basedir, sub, type, bytes); a temporary file's bytes count once more as temp."""
    low = F.col("ft").bitwiseAND(~filetypes.TEMP)
    types = F.when(F.col("ft").bitwiseAND(filetypes.TEMP) > 0, F.array(low, F.lit(filetypes.TEMP))).otherwise(F.array(low))
    return _below(leaf, bases, kind).withColumn("type", F.explode(types)).groupBy("id", "age", "basedir", "sub", "type").agg(F.sum("bytes").alias("bytes"))


def absorb(bases: DataFrame) -> DataFrame:
    """Base directories that lie in another of the same id and age are added to the shallowest such one."""
    keys = bases.select("id", "age", "basedir").distinct()
    above = keys.select("id", "age", "basedir", F.explode(paths.ancestors(F.col("basedir"))).alias("up"))
    top = above.join(keys.withColumnRenamed("basedir", "up"), ["id", "age", "up"]).groupBy("id", "age", "basedir").agg(F.min_by("up", F.length("up")).alias("top"))
    return bases.join(top, ["id", "age", "basedir"]).groupBy("id", "age", F.col("top").alias("basedir")).agg(F.sum("count").alias("count"), F.sum("size").alias("size"), F.min("atime").alias("atime"), F.max("mtime").alias("mtime"))


# ---- other views of files ----

def dupes_by_size(stats: DataFrame, least: int, mount: Column) -> DataFrame:
    """Sizes that at least two sets of links share: (apparent_size, mount, link_set, paths) of each set."""
    files = stats.where((F.col("entry_type") != "d") & (F.col("size") >= least)).withColumn("mount", mount)
    key = F.when(F.col("inode") != 0, F.concat(F.lit("i"), "inode")).otherwise(F.col("path"))
    sets = files.groupBy("apparent_size", "mount", key.alias("link_set")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    often = sets.groupBy("apparent_size").agg(F.count("*").alias("n_sets")).where("n_sets >= 2")
    return sets.join(often, "apparent_size")


def nearest_rank(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p50, p95 and p99 by nearest rank; rows without a value don't count.

    Equal values are summed up first; then ranks are running sums over a key's values in order, which Spark sorts with
    spilling, so no map of a key's values is held."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__upto", F.sum("__c").over(upto))
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("n"))
    met = ranked.join(totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))  # one row
    picks = [F.min(F.when(F.col("__upto") >= F.ceil(F.col("n") * p / 100), F.col(value))).alias(f"p{p}") for p in (50, 95, 99)]
    return met.groupBy(*keys).agg(*picks, F.first("n").alias("n"))


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
