"""Filters over groups and areas."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.functions import formats


def restrict_groups(wanted: DataFrame | None, allowed: DataFrame | None) -> DataFrame:
    """The groups (gid) a request may see: all allowed ones if none are wanted, else those in both; none is an error."""
    if allowed is None:
        return wanted
    out = allowed.select("gid").distinct() if wanted is None else wanted.select("gid").intersect(allowed.select("gid"))
    if out.isEmpty():
        raise ValueError("none of the wanted groups is allowed")
    return out


def area_groups(requests: DataFrame, areas: DataFrame) -> DataFrame:
    """requests (id, area, groups) with the area's groups after their own, each once; an unknown area is an error."""
    known = areas.groupBy("area").agg(F.array_sort(F.collect_set("group_name")).alias("more"))
    out = requests.join(known, "area", "left")
    more = F.when(F.col("more").isNotNull(), F.col("more")).otherwise(F.raise_error(F.concat(F.lit("unknown area: "), F.col("area"))).cast("array<string>"))
    return out.select("id", "area", F.array_distinct(F.concat("groups", more)).alias("groups"))


class Range(NamedTuple):
    """Both ends are in it; None is open."""

    low: float | None = None
    high: float | None = None


class AnyOf(NamedTuple):
    """Values of which a list column must hold one; none given means all rows."""

    values: tuple


def _condition(column: Column, want: list | tuple | Range | AnyOf | Callable[[Column], Column]) -> Column:
    if isinstance(want, Range):
        ends = [column >= want.low] * (want.low is not None) + [column <= want.high] * (want.high is not None)
        return reduce(lambda a, b: a & b, ends, F.lit(True))
    if isinstance(want, AnyOf):
        return F.arrays_overlap(column, F.array(*map(F.lit, want.values))) if want.values else F.lit(True)
    if callable(want):
        return want(column)
    return column.isin(list(want)) if want else F.lit(True)


def table_filter(wants: dict[str, object], columns: dict[str, Column] | None = None) -> Column:
    """A condition from what is wanted of columns, all of it at once: a list of values (an empty one means all), a
    Range, AnyOf for list columns, or a function of the column. `columns` gives names to what must be computed.

    One Column, so Spark pushes what it can of it to the scan."""
    known = columns or {}
    return reduce(lambda a, b: a & b, [_condition(known.get(c, F.col(c)), w) for c, w in wants.items()], F.lit(True))


def usage_filter(view: str, ref_time: int, gids: tuple = (), uids: tuple = (), owners: tuple = (), size: Range = Range(), days: Range = Range(), age: int = 0, text: str = "") -> Column:
    """The filters of a usage table. Group view (gid, uids, owner): groups and owners of a list, any of the users; user
    view (uid, gids): users of a list, any of the groups. Both: size, days since the latest change, age, and a part of
    the base directory."""
    if view not in ("group", "user"):
        raise ValueError(f"no such view: {view}")
    own = {"gid": gids, "uids": AnyOf(uids), "owner": owners} if view == "group" else {"uid": uids, "gids": AnyOf(gids)}
    wants = own | {"usage_size": size, "days": days, "age": [age]} | ({"basedir": lambda c: F.contains(c, F.lit(text))} if text else {})
    return table_filter(wants, {"days": formats.days_ago(F.col("mtime"), ref_time)})


# ---- who may see what ----

def rights(members: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(user, allowed, all) from (user, gid) and the groups (gid) whose members see everything."""
    own = members.join(whitelist.select("gid", F.lit(True).alias("listed")).distinct(), "gid", "left")
    return own.groupBy("user").agg(F.array_sort(F.collect_set("gid")).alias("allowed"), F.coalesce(F.bool_or("listed"), F.lit(False)).alias("all"))  # a user's groups


def authorised(rows: DataFrame, rights: DataFrame, gids: str) -> DataFrame:
    """The rows (user, gids, ...) whose user is in one of the row's groups, or sees everything; others see nothing."""
    met = rows.join(rights, "user")
    return met.where(F.col("all") | F.arrays_overlap(F.col(gids), F.col("allowed"))).select(*rows.columns)


def allowed_subdirs(requests: DataFrame, subdirs: DataFrame, rights: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Requests (user, id, basedir, age) with the rows of subdirs (id, age, basedir, ...) they ask for and may see.

    Without `summary` ids are groups, and the user must be in that group. With it (dir, gids of everything in it) ids
    are users, and the user must be in one of the base directory's groups."""
    if summary is None:
        asked = requests.withColumn("__gids", F.array("id"))
    else:
        asked = requests.join(summary.select(F.col("dir").alias("basedir"), F.col("gids").alias("__gids")), "basedir")
    return authorised(asked, rights, "__gids").drop("__gids").join(subdirs, ["id", "basedir", "age"])
