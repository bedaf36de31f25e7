"""Inputs for the operators, derived from the tables in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REF_TIME = 1_009_843_200  # 2002-01-01
EXT = (".bam", ".CRAM", ".vcf.gz", ".fastq.gz", ".txt", ".log", ".dat.tmp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _day(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400


def stats(spark: SparkSession, sf: str) -> DataFrame:
    """A file per line item; an order's files are links of one inode."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity", "l_shipdate")
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit("/")).alias("place"))
    owners = table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", F.concat("place", F.lower("c_mktsegment"), F.lit("/c"), F.col("c_custkey"), F.lit("/")).alias("home"))
    # line items are dealt out by order once, for their number and for the join with orders that know their place
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(owners, F.col("o_custkey") == F.col("c_custkey"))
    counted = li.withColumn("nlink", F.count("*").over(Window.partitionBy("l_orderkey")))
    rows = counted.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ext = F.element_at(F.array(*map(F.lit, EXT)), F.col("l_linenumber").cast("int"))
    path = F.concat("home", "l_returnflag", F.lit("/"), F.when(F.col("l_linenumber") == 5, "tmp/").otherwise(""), F.lit("o"), "l_orderkey", F.lit("_"), "l_partkey", F.lit("_"), "l_suppkey", F.lit("_"), "l_linenumber", ext)
    zero = F.lit(0).cast("long")
    return rows.select(path.alias("path"), F.floor("l_extendedprice").cast("long").alias("size"), (F.col("c_custkey") % 97).cast("long").alias("uid"), F.col("n_nationkey").cast("long").alias("gid"), _day("l_shipdate").alias("atime"), _day("o_orderdate").alias("mtime"), _day("o_orderdate").alias("ctime"), F.lit("f").alias("entry_type"), F.when(F.col("l_linenumber") == 7, zero).otherwise(F.col("l_orderkey").cast("long") + 1).alias("inode"), F.col("nlink").cast("long").alias("nlink"), zero.alias("device"), (F.col("l_quantity").cast("long") * 100).alias("apparent_size"))


_EXT_SQL = "CASE CAST(l_linenumber AS INTEGER) " + " ".join(f"WHEN {i + 1} THEN '{e}'" for i, e in enumerate(EXT)) + " END"


def _day_sql(c: str) -> str:
    return f"CAST(date_diff('day', DATE '1970-01-01', CAST({c} AS DATE)) AS BIGINT) * 86400"


STATS_SQL = f"""
SELECT concat('/', lower(r_name), '/', lower(n_name), '/', lower(c_mktsegment), '/c', c_custkey, '/', l_returnflag, '/', CASE WHEN l_linenumber = 5 THEN 'tmp/' ELSE '' END,
              'o', l_orderkey, '_', l_partkey, '_', l_suppkey, '_', l_linenumber, {_EXT_SQL}) AS path,
       CAST(floor(l_extendedprice) AS BIGINT) AS size, CAST(c_custkey % 97 AS BIGINT) AS uid, CAST(n_nationkey AS BIGINT) AS gid,
       {_day_sql('l_shipdate')} AS atime, {_day_sql('o_orderdate')} AS mtime, {_day_sql('o_orderdate')} AS ctime, 'f' AS entry_type,
       CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_orderkey AS BIGINT) + 1 END AS inode,
       count(*) OVER (PARTITION BY l_orderkey) AS nlink, CAST(0 AS BIGINT) AS device, CAST(l_quantity AS BIGINT) * 100 AS apparent_size
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def quotas(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 7 <> 0")
    g = F.col("n_nationkey").cast("long")
    return n.select(g.alias("gid"), F.concat(F.lit("/"), F.lower("r_name"), F.lit("/")).alias("disk"), (2_000_000 * (1 + g)).alias("size_quota"), (100 * (1 + g)).alias("inode_quota"), g.alias("ordinal"))


QUOTAS_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS gid, concat('/', lower(r_name), '/') AS disk, CAST(2000000 * (1 + n_nationkey) AS BIGINT) AS size_quota, CAST(100 * (1 + n_nationkey) AS BIGINT) AS inode_quota, CAST(n_nationkey AS BIGINT) AS ordinal FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 0"


def owners(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("gid"), F.concat(F.lit("PI_"), "n_name").alias("owner"))


OWNERS_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS gid, concat('PI_', n_name) AS owner FROM nation WHERE n_nationkey % 2 = 0"


def areas(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("group_name"), F.col("r_name").alias("area"))


AREAS_SQL = "SELECT n_name AS group_name, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey"


def mounts(spark: SparkSession, sf: str) -> DataFrame:
    """/ and the mounts of three regions; the others fall back to /."""
    return table(spark, sf, "region").where("r_name IN ('AFRICA', 'ASIA', 'EUROPE')").select(F.concat(F.lit("/"), F.lower("r_name"), F.lit("/")).alias("mount")).union(table(spark, sf, "region").limit(1).select(F.lit("/").alias("mount")))


MOUNTS_SQL = "SELECT concat('/', lower(r_name), '/') AS mount FROM region WHERE r_name IN ('AFRICA', 'ASIA', 'EUROPE') UNION ALL SELECT '/'"


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's order value and count to the end of each year, against a quota that odd nations keep."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy(F.col("c_nationkey").cast("long").alias("gid"), F.year("o_orderdate").alias("year")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("v"), F.count("*").alias("n"))
    w = Window.partitionBy("gid").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    h = y.withColumn("usage_size", F.sum("v").over(w)).withColumn("usage_inodes", F.sum("n").over(w))
    last = Window.partitionBy("gid")
    quota = lambda c: F.floor(F.max(c).over(last) * F.when(F.col("gid") % 2 == 1, 12).otherwise(9) / 10).cast("long")
    h = h.withColumn("quota_size", quota("usage_size")).withColumn("quota_inodes", quota("usage_inodes"))
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("gid"), F.concat(F.lit("/"), F.lower("r_name"), F.lit("/")).alias("mount_path"))
    date = F.datediff(F.make_date("year", F.lit(12), F.lit(31)), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return h.join(n, "gid").select("gid", "mount_path", date.alias("date"), "usage_size", "quota_size", "usage_inodes", "quota_inodes")


HISTORY_SQL = """
SELECT h.gid, concat('/', lower(r_name), '/') AS mount_path, CAST(date_diff('day', DATE '1970-01-01', make_date(CAST(year AS BIGINT), 12, 31)) AS BIGINT) * 86400 AS date,
  CAST(usage_size AS BIGINT) AS usage_size, CAST(floor(max(usage_size) OVER (PARTITION BY h.gid) * CASE WHEN h.gid % 2 = 1 THEN 12 ELSE 9 END / 10) AS BIGINT) AS quota_size,
  CAST(usage_inodes AS BIGINT) AS usage_inodes, CAST(floor(max(usage_inodes) OVER (PARTITION BY h.gid) * CASE WHEN h.gid % 2 = 1 THEN 12 ELSE 9 END / 10) AS BIGINT) AS quota_inodes
FROM (SELECT gid, year, sum(v) OVER (PARTITION BY gid ORDER BY year) AS usage_size, sum(n) OVER (PARTITION BY gid ORDER BY year) AS usage_inodes
      FROM (SELECT CAST(c_nationkey AS BIGINT) AS gid, year(o_orderdate) AS year, sum(CAST(floor(o_totalprice) AS BIGINT)) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) h
JOIN nation ON n_nationkey = h.gid JOIN region ON n_regionkey = r_regionkey
"""


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Names of snapshots: one per region and year of orders, some of them with textual versions or no valid name."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    y = F.year("o_orderdate")
    version = F.when((F.col("r_name") == "AFRICA") | (y == 1996), F.concat(F.lit("v"), (y - 1990).cast("string"))).when(F.col("r_name") == "EUROPE", F.when(y > 1997, ".x").otherwise((y - 1988).cast("string"))).otherwise((y - 1988).cast("string"))
    return o.select(F.concat(version, F.lit("_／"), F.lower("r_name"), F.when(F.col("r_name") == "AMERICA", "_a").otherwise("")).alias("name")).distinct()


DATASETS_SQL = """
SELECT DISTINCT concat(CASE WHEN r_name = 'AFRICA' OR year(o_orderdate) = 1996 THEN concat('v', year(o_orderdate) - 1990) WHEN r_name = 'EUROPE' AND year(o_orderdate) > 1997 THEN '.x' ELSE CAST(year(o_orderdate) - 1988 AS VARCHAR) END,
  '_／', lower(r_name), CASE WHEN r_name = 'AMERICA' THEN '_a' ELSE '' END) AS name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
