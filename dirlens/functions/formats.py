"""Values as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
DAY = 86_400


def size_from_text(text: Column) -> Column:
    """Bytes of 50M, 1K, 3T or a plain number."""
    unit = F.upper(F.regexp_extract(text, r"^[0-9.]+([KMGTPEkmgtpe]?)", 1))
    factor = F.create_map(*[F.lit(x) for i, u in enumerate(["", *"KMGTPE"]) for x in (u, float(1024**i))])
    return (F.regexp_extract(text, r"^([0-9.]+)", 1).cast("double") * factor[unit]).cast("long")


def size_text(size: Column) -> Column:
    """IEC units, at most two decimals."""
    step = F.least(F.lit(len(UNITS) - 1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) / 10))).cast("int")
    return F.concat(F.round(size / F.pow(F.lit(1024.0), step), 2).cast("decimal(20,2)").cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), step + 1))


def days_ago(time: Column, ref_time: int) -> Column:
    return F.greatest(F.lit(0), F.floor((F.lit(ref_time) - time) / DAY))


def time_ago(time: Column, ref_time: int) -> Column:
    """~ n years, months, days, hours, minutes or seconds ago: the largest unit that fits."""
    s, out = F.lit(ref_time) - time, None
    for name, n in (("year", 365 * DAY), ("month", 30 * DAY), ("day", DAY), ("hour", 3600), ("minute", 60), ("second", 1)):
        count = F.floor(s / n)
        told = F.concat(F.lit("~ "), count.cast("string"), F.lit(f" {name}"), F.when(count == 1, "").otherwise("s"), F.lit(" ago"))
        out = F.when(s >= n, told) if out is None else out.when(s >= n, told)
    return out.otherwise("just now")


def recency_class(time: Column, ref_time: int) -> Column:
    """0 (over seven years) to 8: a class of its own beyond each bound."""
    days, out = (F.lit(ref_time) - time) / DAY, None
    for i, bound in enumerate((7 * 365, 5 * 365, 3 * 365, 2 * 365, 365, 180, 60, 30)):
        out = F.when(days > bound, i) if out is None else out.when(days > bound, i)
    return out.otherwise(8)


def percent_of(used: Column, quota: Column) -> Column:
    """With two decimals; null without a quota."""
    return F.round(10000 * used / F.when(quota != 0, quota)) / 100


def quota_status(date_no_space: Column, date_no_files: Column, ref_time: int, days: int = 3) -> Column:
    """Not OK if a quota will be used up within some days."""
    soon = lambda c: F.coalesce(c <= ref_time + days * DAY, F.lit(False))
    return F.when(soon(date_no_space) | soon(date_no_files), "Not OK").otherwise("OK")


def iso_time(time: Column) -> Column:
    """Epoch seconds as 2001-02-03T04:05:06Z."""
    return F.concat(F.replace(F.date_format(F.timestamp_seconds(time), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.lit("T")), F.lit("Z"))


def sane_time(time: Column, fallback: Column) -> Column:
    """Epoch seconds of years 0 to 9999, else the fallback."""
    return F.when((time >= -62167219200) & (time < 253402300800), time).otherwise(fallback)
