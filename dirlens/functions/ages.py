"""Ages: cumulative codes 0 to 16, and exclusive histogram buckets. The time of reference is always an argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a month for codes, and months of each; days' bounds of buckets from old to young.
MONTH = 2_628_000
CODE_MONTHS = (1, 2, 6, 12, 24, 36, 60, 84)
BUCKET_DAYS = (7 * 365, 5 * 365, 3 * 365, 2 * 365, 365, 6 * 30, 2 * 30, 30)
DAY = 86_400
CODES = ("1M", "2M", "6M", "1Y", "2Y", "3Y", "5Y", "7Y")


def level(time: Column, ref_time: int) -> Column:
    """How many of the eight thresholds a time has passed; codes up to it hold the file."""
    return reduce(lambda a, b: a + b, [F.when(time <= ref_time - m * MONTH, 1).otherwise(0) for m in CODE_MONTHS])


def codes(a_level: Column, m_level: Column) -> Column:
    """0, then 1 to a_level by access, then 9 to 8 + m_level by change."""
    by_access, by_change = F.sequence(F.lit(0), a_level), F.sequence(F.lit(9), m_level + 8)
    return F.when(m_level > 0, F.concat(by_access, by_change)).otherwise(by_access)


def bucket(time: Column, ref_time: int) -> Column:
    """0 (over seven years) to 8 (under a month); null unless time is positive."""
    age, out = F.lit(ref_time) - time, None
    for i, days in enumerate(BUCKET_DAYS):
        out = F.when(age >= days * DAY, i) if out is None else out.when(age >= days * DAY, i)
    return F.when(time > 0, out.otherwise(8))


def age_from_code(code: Column) -> Column:
    """0 to 16 of a number or of A or M with a span; anything else is an error."""
    named = {f"{k}{c}": i + 1 + 8 * (k == "M") for k in "AM" for i, c in enumerate(CODES)} | {c: i + 1 for i, c in enumerate(CODES)} | {str(i): i for i in range(17)}
    table = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    return F.coalesce(table[code], F.raise_error(F.concat(F.lit("invalid age: "), code)).cast("int"))
