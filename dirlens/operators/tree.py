"""Tree queries over a summary table (dir, count, size, ...), as joins of directories with their ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlens.functions import filetypes, paths

#: What `where` counts if no type is asked for: all types but directories and the temp bit.
FILES = filetypes.ALL & ~filetypes.TEMP & ~filetypes.DIR


def children_of(summary: DataFrame) -> DataFrame:
    return summary.withColumn("parent_dir", paths.parent_dir(F.col("dir")))


def _with_children(summary: DataFrame) -> DataFrame:
    """Each directory with the number, total and largest of its children's counts."""
    sums = children_of(summary).where("parent_dir IS NOT NULL").groupBy(F.col("parent_dir").alias("dir")).agg(F.count("*").alias("n_children"), F.sum("count").alias("child_count"), F.max("count").alias("child_max"))
    return summary.join(sums, "dir", "left")


def dir_info(summary: DataFrame, directory: str, cube: DataFrame | None = None) -> DataFrame:
    """The directory and its children: kind current or child. Nothing, if nothing in it passes the summary's filter; an
    error, if `cube` is given and has no such directory at all."""
    if cube is not None and cube.where(F.col("dir") == directory).isEmpty():
        raise ValueError(f"no such directory: {directory}")
    own = children_of(summary).where((F.col("dir") == directory) | (F.col("parent_dir") == directory))
    return own.withColumn("kind", F.when(F.col("dir") == directory, "current").otherwise("child"))


def dir_has_children(summary: DataFrame) -> DataFrame:
    """Directories, each with whether anything that passes lies in a child."""
    return _with_children(summary).select("dir", (F.coalesce("n_children", F.lit(0)) > 0).alias("has_children"))


def children(summary: DataFrame, directory: str) -> DataFrame:
    return children_of(summary).where(F.col("parent_dir") == directory).select("dir").distinct()


def where(summary: DataFrame, directory: str, splits: int) -> DataFrame:
    """The deepest directories that hold all that matches, and `splits` levels below them.

    A directory whose only child holds as much is passed through. So the answer is all others below `directory` with
    at most `splits` such directories above them."""
    stops = _with_children(summary.where(F.startswith("dir", F.lit(directory)))).where("NOT (coalesce(n_children, 0) = 1 AND child_max = count)")
    above = stops.select("dir", F.explode(F.filter(paths.ancestors(F.col("dir")), lambda a: F.startswith(a, F.lit(directory)))).alias("up")).where("up <> dir")
    met = above.join(stops.select(F.col("dir").alias("up")), "up").groupBy("dir").agg(F.count("*").alias("n_above"))
    out = stops.join(met, "dir", "left").where(F.coalesce("n_above", F.lit(0)) <= splits)
    return out.select(*summary.columns)


def file_locations(summary: DataFrame, directory: str) -> DataFrame:
    """The first directory on each branch that holds matching files itself."""
    direct = _with_children(summary.where(F.startswith("dir", F.lit(directory)))).where("coalesce(child_count, 0) < count")
    above = direct.select("dir", F.explode(F.filter(paths.ancestors(F.col("dir")), lambda a: F.startswith(a, F.lit(directory)))).alias("up")).where("up <> dir")
    covered = above.join(direct.select(F.col("dir").alias("up")), "up", "left_semi").select("dir").distinct()
    return direct.join(covered, "dir", "left_anti").select(*summary.columns)


def representative_dir(summary: DataFrame, least: int = 1000, most: int = 20000) -> DataFrame:
    """From the root into the largest child each time, the first directory with least to most files."""
    largest = F.min_by(F.struct("dir", "count"), F.struct(-F.col("count"), F.col("dir")))
    heavy = children_of(summary).groupBy("parent_dir").agg(largest.alias("x")).select("x.*")
    chain = heavy.select("dir", "count", F.explode(paths.ancestors(F.col("dir"))).alias("up")).join(heavy.select(F.col("dir").alias("up")), "up", "left_semi")
    whole = chain.groupBy("dir", "count").agg(F.count("*").alias("n")).where(F.col("n") == paths.depth(F.col("dir")) + 1)
    return whole.where(F.col("count").between(least, most)).orderBy("n").limit(1).select("dir", "count")


def treemap_children(summary: DataFrame, directory: str, by: str = "size", most: int = 1000) -> DataFrame:
    own = children_of(summary).where((F.col("parent_dir") == directory) & (F.col(by) > 0))
    return own.orderBy(F.desc(by), "dir").limit(most).select("dir", F.col(by).alias("value"), "atime", "mtime")


def mark_noauth(rows: DataFrame, allowed: list[int] | None) -> DataFrame:
    """noauth where none of a row's groups is allowed; None allows all."""
    return rows.withColumn("noauth", F.lit(False) if allowed is None else ~F.arrays_overlap("gids", F.array(*[F.lit(g).cast("long") for g in allowed])))


def tree_element(summary: DataFrame, directory: str, allowed: list[int] | None) -> DataFrame:
    """dir_info with has_children and noauth; what may not be read hides its children."""
    info = mark_noauth(dir_info(summary, directory), allowed).join(dir_has_children(summary), "dir")
    return info.withColumn("has_children", F.col("has_children") & ~F.col("noauth"))
