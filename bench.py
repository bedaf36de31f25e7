"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import quantiles

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: The suite of the baseline, on stored tables where it answers from stored ones, and the builds of these tables.
REPEATS = int(os.environ.get("BENCH_REPEATS", "5"))


def main() -> None:
    import shutil
    import tempfile

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from dirlens.functions import paths
    from dirlens.operators import basedirs, rollup, tree, usage
    from dirlens.plans import usage_queries, views
    from dirlens.sources import files

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, percent = {}, {}

    def run(name: str, f, repeats: int) -> None:
        times = []
        for _ in range(repeats + (repeats > 1)):
            began = time.perf_counter()
            f().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        times = times[1:] or times  # the first warms up
        took[name] = round(min(times), 3)
        q = quantiles(times, n=20, method="inclusive") if len(times) > 1 else times * 19
        percent[name] = {"p50": round(q[9], 3), "p95": round(q[18], 3), "max": round(max(times), 3)}

    # the listing of files, which the tables stand for; then the stores that tree and base-directory requests read
    folder = tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp")

    def kept(name: str, df, *by: str):
        df = df.repartitionByRange(*by, "id") if by else df  # a task writes few partitions
        df.write.partitionBy(*by).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    began = time.perf_counter()
    stats = kept("stats", views.stats(spark, SF))
    took["derive_listing"] = round(time.perf_counter() - began, 3)
    region = F.regexp_extract("path", "^(/[^/]+/)", 1)
    run("build_by_user_group_dir", lambda: rollup.by_user_group_dir(stats), 1)
    run("build_dupes_by_size", lambda: basedirs.dupes_by_size(stats, 50_000, region), 1)
    cube = rollup.dguta(stats.withColumn("mount_path", region), views.REF_TIME, ("mount_path",))
    began = time.perf_counter()
    files.write_dguta(cube, f"{folder}/dguta", F.lit(views.REF_TIME))
    took["build_dguta"] = round(time.perf_counter() - began, 3)
    began = time.perf_counter()
    leaf = kept("leaf", basedirs.unit_files(stats, usage_queries.rules(spark, SF), views.REF_TIME))
    for kind in ("gid", "uid"):
        b = kept(f"bases_{kind}", basedirs.basedirs(leaf, kind), "age")
        kept(f"subs_{kind}", basedirs.subdirs(leaf, b, kind), "age")
    took["build_basedirs"] = round(time.perf_counter() - began, 3)
    stored = spark.read.parquet(f"{folder}/dguta")
    asia = rollup.dir_summary(rollup.guta_filter(stored.where("mount_path = '/asia/'"), mask=tree.FILES))
    read = lambda n: spark.read.parquet(f"{folder}/{n}").where("age = 0")
    suite = {
        "mount_timestamps": lambda: files.mount_timestamps(stored),
        "tree_dirinfo": lambda: tree.dir_info(rollup.dir_summary(rollup.guta_filter(stored.where((F.col("mount_path") == "/asia/") & ((F.col("dir") == "/asia/") | (paths.parent_dir(F.col("dir")) == "/asia/"))), mask=tree.FILES)), "/asia/"),
        "tree_where": lambda: tree.where(asia, "/asia/", 4),
        "basedirs_group_usage": lambda: usage.quota_for_dir(read("bases_gid").withColumnRenamed("id", "gid"), views.quotas(spark, SF)),
        "basedirs_user_usage": lambda: read("bases_uid"),
        "basedirs_group_subdirs": lambda: read("subs_gid").where("id = 7"),
        "basedirs_user_subdirs": lambda: read("subs_uid").where("id = 17"),
        "basedirs_history": lambda: usage.history_of(views.history(spark, SF), 7, "/asia/nation_7/"),
    }
    for name, f in suite.items():
        run(name, f, REPEATS)
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "percentiles": percent, "sf": SF.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
