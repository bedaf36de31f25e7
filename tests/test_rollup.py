"""Measures over directories against plain loops, and what is shuffled for them."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from dirlens.functions import filetypes, paths
from dirlens.operators import rollup

SCHEMA = "dir string, k string, size long, uid long, t long, __s0 long"


def _up(d):
    parts = d.strip("/").split("/") if d != "/" else []
    return ["/"] + ["/" + "/".join(parts[: i + 1]) + "/" for i in range(len(parts))]


def _measures():
    c = F.col
    return [rollup.count("n"), rollup.total("size", c("size")), rollup.least("a", c("t")), rollup.greatest("b", c("t")), rollup.average("mean", c("size")), rollup.first_by("who", c("uid"), c("t"))]


def test_measures_equal_loops(spark):
    rng = random.Random(3)
    some = lambda *v: rng.choice(v)
    rows = [(some("/", "/a/", "/a/b/", "/a/b/c/", "/d/", None), some("x", "y", None), some(None, 1, 2, 30), some(None, 1, 2, 3), some(None, 5, 6, 7), 0) for _ in range(400)]
    groups = defaultdict(list)
    for d, k, *v in rows:
        for a in _up(d) if d else ():
            groups[a, k].append(v)

    def told(v):
        sizes, times = ([x[i] for x in v if x[i] is not None] for i in (0, 2))
        first = min(v, key=lambda x: (x[2] is None, x[2] or 0, x[1] is not None, x[1] or 0))[1]
        return len(v), sum(sizes) if sizes else None, min(times, default=None), max(times, default=None), sum(sizes) / len(sizes) if sizes else None, first, len({x[1] for x in v} - {None}), len(set(sizes))

    got = rollup.directory_rollup(spark.createDataFrame(rows, SCHEMA), F.col("dir"), ["k"], _measures(), {"users": F.col("uid"), "sizes": F.col("size")})
    assert {(r.dir, r.k): tuple(r)[2:] for r in got.collect()} == {k: told(v) for k, v in groups.items()}


def test_empty_and_without_measures(spark):
    rows = spark.createDataFrame([("/a/", "x", 1, 1, 1, 0)], SCHEMA)
    assert rollup.directory_rollup(rows.limit(0), F.col("dir"), [], _measures(), {"u": F.col("uid")}).count() == 0
    assert sorted(map(tuple, rollup.directory_rollup(rows, F.col("dir"), ["k"], []).collect())) == [("/", "x"), ("/a/", "x")]
    assert sorted(map(tuple, rollup.directory_rollup(rows, F.col("dir"), [], [], {"u": F.col("uid")}).collect())) == [("/", 1), ("/a/", 1)]


def test_states_are_dealt_out_not_rows(spark, tmp_path):
    """Rows that reach the explode: one for each directory, where rows of directories were each dealt out before."""
    deep = F.concat(F.lit("/a/b/c/d/e"), (F.col("id") % 4).cast("string"), F.lit("/"))
    spark.range(20_000).select(deep.alias("dir"), F.col("id").alias("size"), (F.col("id") % 5).alias("uid")).write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))

    def dealt(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
        total, todo = 0, [plan]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Generate":
                total += node.metrics().apply("numOutputRows").value()
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
            if re.match("(Shuffle|Broadcast)?QueryStage", node.nodeName()):
                todo.append(node.plan())
        return total

    new = rollup.directory_rollup(rows, F.col("dir"), [], [rollup.total("size", F.col("size"))], {"users": F.col("uid")})
    old = rollup.directory_rollup_rows(rows, F.col("dir"), [], [F.sum("size").alias("size"), F.count_distinct("uid").alias("users")])
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
    assert dealt(new) == 4 * 5 * 6 and dealt(old) == 20_000 * 6


def test_a_subtree_is_dealt_out_once(spark):
    """Rows of the shuffles of dguta: of deep directories one for each of a leaf's classes, not one for each ancestor
    by classes and again by keys."""
    stats = spark.range(400).select(
        F.concat(F.lit("/a/b/c/d"), (F.col("id") % 4).cast("string"), F.lit("/h"), F.col("id").cast("string"), F.lit("/e/f/g/x.txt")).alias("path"), F.lit("f").alias("entry_type"),
        *[F.lit(1).cast("long").alias(c) for c in ("size", "gid", "uid", "mtime", "ctime", "nlink", "inode", "device", "apparent_size")], F.col("id").alias("atime"))
    cube = rollup.dguta(stats, 10**9)
    told = {(r.dir, r.ft): r["count"] for r in cube.where("age = 0").collect()}
    txt = next(ft for d, ft in told if ft != filetypes.DIR)
    assert told["/", txt] == 400 and told["/a/b/c/d1/", txt] == 100 and told["/a/b/c/d1/h1/e/f/g/", txt] == 1 and told["/", filetypes.DIR] == len({d for d, _ in told})
    cube.collect()
    total, todo = 0, [cube._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.finalPhysicalPlan())
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if re.match("(Shuffle|Broadcast)?QueryStage", node.nodeName()):
            todo.append(node.plan())
    assert total < 8_000  # 10 453 before, 6 050 so


def test_summaries_sum_up_files_before_ancestors_get_them(spark):
    """Rows of the shuffle by directory, gid and uid: sums, where each file was dealt out to all its ancestors before."""
    stats = spark.range(2_000).select(
        F.concat(F.lit("/a/b/c/d"), (F.col("id") % 4).cast("string"), F.lit("/e/f/g/x"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.lit("f").alias("entry_type"),
        *[F.lit(1).cast("long").alias(c) for c in ("size", "gid", "uid", "mtime", "ctime", "nlink", "inode", "device", "apparent_size")], F.col("id").alias("atime"))
    rows = rollup.summarise(stats, 10**9, mask=filetypes.ALL & ~filetypes.DIR)
    told = {r.dir: r["count"] for r in rows.collect()}
    assert told["/"] == told["/a/b/c/"] == 2_000 and told["/a/b/c/d1/"] == told["/a/b/c/d1/e/f/g/"] == 500 and len(told) == 4 + 4 * 4
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(plan) if "RepartitionByExpression [subtree" in line)
    assert any("Generate explode" in line for line in plan[:dealt]) and sum("Aggregate [" in line for line in plan[:dealt]) == 4


def test_types_are_worked_out_once(spark):
    """A filter on the type stays above what tells it, so that the plan has its expression once."""
    stats = spark.createDataFrame([("/a/b/x.bam", 1, 1, 1, 1, 1, "f", 1, 1)], "path string, size long, uid long, gid long, atime long, mtime long, entry_type string, inode long, nlink long")
    plan = rollup.enriched(stats, 10**9).where("ft & 32 > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(".fastq.gz") == 1


def test_ancestors_of_odd_directories(spark):
    # no directory counts as the root, as it always did
    odd = ["/", "/a/", "/a/b/c/", "//a//b/", "a/b/", "/a/b", "", None]
    split = [["/"] + ["/" + "/".join(p[: i + 1]) + "/" for i in range(len(p))] for d in odd for p in [[x for x in (d or "").split("/") if x]]]
    rows = spark.createDataFrame([(d,) for d in odd], "d string").select("d", paths.ancestors(F.col("d")).alias("a"), paths.ancestors(F.col("d"), 2).alias("two"), paths.top(F.col("d"), 1).alias("top"), paths.common(F.lit("/a/b/x/"), F.coalesce("d", F.lit("/"))).alias("common")).collect()
    assert [r.a for r in rows] == split
    assert [r.two for r in rows][1:4] == [["/a/"], ["/a/b/", "/a/b/c/"], ["/a/b/"]]
    assert [r.top for r in rows] == ["/", "/a/", "/a/", "/a/", "/a/", "/a/", "/", None]
    assert [r.common for r in rows] == ["/", "/a/", "/a/b/", "/a/b/", "/a/b/", "/a/b/", "/", "/"]


def test_types_by_endings_equal_their_patterns(spark):
    """Columns look endings up; PATTERNS, which the SQL twins read, tell the same."""
    names = ["x" + e for _, some in filetypes.ENDINGS for e in some] + [f"a.{e}" for _, some in filetypes.ENDINGS for e in some] + ["a.VCF.gz", "a.fq.gz", "a.fastq.gz", "README", "xreadme", "a.readme", "dir.bam/", "nofa", "gz", ".gz", "bam", "a.bam.", "", "a.temp.b", "tmp.x"]
    first = [next((bit for bit, p in filetypes.PATTERNS if re.search(p, n.lower())), filetypes.OTHER) for n in names]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", filetypes.file_type(F.col("n")).alias("ft"), F.coalesce(filetypes.is_temp(F.col("n")), F.lit(False)).alias("temp"))
    got = sorted(map(tuple, rows.collect()))
    assert [x[1] for x in got] == first and [x[2] for x in got] == [bool(re.search(filetypes.TEMP_PATTERN, n.lower())) for n in names]


def test_what_multiplies_rows_has_tasks_of_its_own(spark):
    """Exchanges before ancestors and ages have a number of tasks that adaptive execution keeps; it put tasks together by
    what they read, and their sums spilled."""
    stats = spark.createDataFrame([(f"/a/b/c/d{i}/e/x.bam", 1, 1, 1, 1, 1, "f", 1, 1) for i in range(9)], "path string, size long, uid long, gid long, atime long, mtime long, entry_type string, inode long, nlink long")
    stats = stats.withColumn("ctime", F.col("mtime"))
    levels = rollup.levels(stats, 10**9)
    told = lambda df: [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line and "inode" not in line]
    n = str(2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    for df, least in ((rollup.dguta(stats, 10**9), 2), (rollup.aged(levels), 2), (rollup.merge_cubes(levels), 2), (levels, 1), (rollup.summarise(stats, 10**9), 1)):
        assert len(told(df)) >= least and all(line.rstrip().endswith(f", {n}") for line in told(df))
    assert sorted(map(tuple, rollup.dguta(stats, 10**9).collect())) == sorted(map(tuple, rollup.aged(levels).collect()))
