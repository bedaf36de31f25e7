import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from dirlens.operators import filters, logs, usage
from dirlens.plans import views
from dirlens.sources import files
from dirlens.streaming import jobs


def test_listing(spark, tmp_path):
    with gzip.open(tmp_path / "x.stats.gz", "wt") as f:
        f.write('"/a/b\\tc"\t1\t2\t3\t4\t5\t6\tf\t7\t1\t0\t9\n\n"/a/"\t0\t0\t0\t0\t0\t0\tf\t0\t2\t0\t0\n')
    rows = files.scan_stats(spark, str(tmp_path), 2).orderBy("path").collect()
    assert [(r.path, r.entry_type, r.apparent_size) for r in rows] == [("/a/", "d", 0), ("/a/b\tc", "f", 9)] and rows[0].source.endswith("x.stats.gz")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "y").write_text('"/a"\t1\n')
    with pytest.raises(Exception, match="too few columns"):
        files.scan_stats(spark, str(tmp_path / "bad")).collect()


def test_dimension_files(spark, tmp_path):
    (tmp_path / "q").write_text("1,/lustre/scratch125,4000,20\n2,/x/,300,30\n")
    assert [tuple(r)[:4] for r in files.load_quotas(spark, str(tmp_path / "q")).orderBy("gid").collect()] == [(1, "/lustre/scratch125/", 4000, 20), (2, "/x/", 300, 30)]
    (tmp_path / "o").write_text("1,Alan\n2,Barbara\n1,Zed\n")
    assert {r.gid: r.owner for r in files.load_owners(spark, str(tmp_path / "o")).collect()} == {1: "Zed", 2: "Barbara"}
    (tmp_path / "bad").write_text("1,2,3\n")
    with pytest.raises(Exception, match="wrong number of columns"):
        files.load_owners(spark, str(tmp_path / "bad")).collect()


def test_datasets(spark):
    names = spark.createDataFrame([(n,) for n in ("10_／asia", "9_／asia", "v2_／asia", "v10_／africa", "v9_／africa", ".hidden_x", "noversion", "_x", "3_／europe_a")], "name string")
    assert {r.key: r.name for r in files.latest_datasets(names).collect()} == {"／asia": "10_／asia", "／africa": "v9_／africa", "／europe_a": "3_／europe_a"}
    assert {r.name for r in files.superseded_datasets(names).collect()} == {"9_／asia", "v2_／asia", "v10_／africa"}
    done = spark.createDataFrame([("10_／asia",), (".3_／europe_a",)], "name string")
    assert [r.name for r in files.pending_datasets(names, done).collect()] == ["v9_／africa"]


def test_log_lines(spark):
    lines = [("r", "f", 1, "t=2025-01-02T03:04:05+0000 lvl=info msg=syscalls file=/p/walk.1 host=h1 opens=3 reads=4 bytes=4096"), ("r", "f", 2, 't=2025-01-02T03:05:05+0000 lvl=eror msg="an \\"error" arg1=x arg2="y z"'), ("r", "f", 3, "t=2025-01-02T03:08:05+0000 msg=syscalls file=/q/walk.1 opens=6"), ("r", "f", 4, "  ")]
    p = logs.parse(spark.createDataFrame(lines, "run string, file string, line_no long, value string"))
    ev = logs.events(p).orderBy("line_no").collect()
    assert [(r.time, r.host, r.opens, r.bytes, r.closes) for r in ev] == [(1735787045, "h1", 3, 4096, None), (1735787285, "h1", 6, None, None)]
    err = logs.errors(p).collect()
    assert [(r.message, r.data) for r in err] == [('an "error', {"arg1": "x", "arg2": "y z"})]
    assert {r.minute - 1735787045 // 60: r.calls for r in logs.minute_rates(logs.events(p)).collect()} == {0: 7, 1: 1.5, 2: 1.5, 3: 1.5, 4: 1.5}


def test_groups(spark):
    g = lambda *ids: spark.createDataFrame([(i,) for i in ids], "gid long")
    assert {r.gid for r in filters.restrict_groups(g(1, 2), g(2, 3)).collect()} == {2} and {r.gid for r in filters.restrict_groups(None, g(2, 3)).collect()} == {2, 3}
    with pytest.raises(ValueError):
        filters.restrict_groups(g(1), g(2))
    areas = spark.createDataFrame([("g1", "A"), ("g2", "A")], "group_name string, area string")
    with pytest.raises(Exception, match="unknown area"):
        filters.area_groups(spark.createDataFrame([(1, "B", ["x"])], "id int, area string, groups array<string>"), areas).collect()


def test_history_stream_appends_only_later_points(spark, sf, tmp_path):
    h = views.history(spark, sf)
    source, out, mark = (str(tmp_path / n) for n in "soc")
    n = 0
    for limit in ("date < 900000000", "date < 950000000", "date > 0"):
        h.where(limit).coalesce(1).write.mode("append").parquet(source)
        jobs.append_history(spark.readStream.schema(h.schema).parquet(source), out, mark).awaitTermination()
        n = h.where(limit).count()
        assert spark.read.parquet(f"{out}/points").count() == n
    assert n == h.count()
    h.where("date < 900000000").coalesce(1).write.mode("append").parquet(source)  # too late
    jobs.append_history(spark.readStream.schema(h.schema).parquet(source), out, mark).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{out}/points").drop("batch").collect())) == sorted(map(tuple, h.collect()))


def test_stored_cube_and_its_mounts(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "mount_path string, dir string, n int"
    files.write_dguta(spark.createDataFrame([("/a/", "/a/x/", 1), ("/b/", "/b/", 2)], schema), path, F.lit(10))
    files.write_dguta(spark.createDataFrame([("/a/", "/a/y/", 3), ("/a/", "/a/y/z/", 4)], schema), path, F.lit(11))
    read = lambda **k: sorted((r.dir, r.n) for r in files.union_sources(spark, path, **k).collect())
    assert read() == [("/a/y/", 3), ("/a/y/z/", 4), ("/b/", 2)] and read(mount="/a/", directory="/a/y/z/") == [("/a/y/z/", 4)]
    assert {r.mount_path: r.updated_at for r in files.mount_timestamps(files.union_sources(spark, path)).collect()} == {"/a/": 11, "/b/": 10}
    with pytest.raises(Exception, match="not a mount path"):
        files.write_dguta(spark.createDataFrame([("/a", "/a/", 1)], schema), path, F.lit(1))


def test_base_directory_tables_keep_history(spark, tmp_path):
    path = str(tmp_path / "b")
    use = lambda *ids: spark.createDataFrame([("/a/", "gid", 0, i) for i in ids], "mount_path string, kind string, age int, id long")
    points = lambda *dates: spark.createDataFrame([(1, "/a/", d) for d in dates], "gid long, mount_path string, date long")
    files.write_basedirs(path, use(1, 2), use(1), points(5, 6))
    files.write_basedirs(path, use(3), use(4, 5), points(4, 6, 7))
    assert [r.id for r in spark.read.parquet(f"{path}/usage").collect()] == [3]
    assert sorted(r.id for r in spark.read.parquet(f"{path}/subdirs").collect()) == [4, 5]
    assert sorted(r.date for r in spark.read.parquet(f"{path}/history").collect()) == [5, 6, 7]


def test_datasets_are_published_and_superseded_ones_removed(spark, tmp_path):
    root = str(tmp_path / "d")
    rows = lambda n: spark.createDataFrame([(n,)], "n int")
    for i, name in enumerate(("1_／a", "3_／b／c", "2_／a")):
        files.publish(rows(i), root, name)
    (tmp_path / "d" / "9_／a").mkdir()  # not complete
    assert {(r.mount_path, r.n) for r in files.read_latest(spark, root).collect()} == {("/a/", 2), ("/b/c/", 1)}
    assert files.drop_superseded(spark, root) == ["1_／a"]
    assert {r.name for r in files.dataset_names(spark, root).collect()} == {"3_／b／c", "2_／a"}


def test_ui_events_are_read_by_day(spark, tmp_path):
    path, day = str(tmp_path / "u"), 86_400
    event = lambda *times: spark.createDataFrame([("u", "s", "{}", t) for t in times], "user string, session string, state string, time long")
    files.append_ui_events(event(0, day - 1, day), path)
    files.append_ui_events(event(5 * day, -1), path)
    assert sorted(r.time for r in files.scan_ui_events(spark, path).collect()) == [-1, 0, day - 1, day, 5 * day]
    some = files.scan_ui_events(spark, path, day - 1, day)
    assert sorted(r.time for r in some.collect()) == [day - 1, day]
    assert "PartitionFilters: [isnotnull(date" in some._jdf.queryExecution().toString()


def test_log_folders(spark, tmp_path):
    for name in ("r1/walk.log", "r1/other.log", "r2/logs.gz"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        data = b"lvl=info msg=syscalls opens=1\n"
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    assert sorted((r.run, r.file) for r in files.scan_logs(spark, str(tmp_path)).collect()) == [("r1", "other"), ("r1", "walk"), ("r2", "walk")]


def test_error_preview(spark):
    rows = [(r, i % 3, f"f{i}", i) for r, n in (("a", 7), ("b", 8), ("c", 30)) for i in range(n)]
    got = logs.error_preview(spark.createDataFrame(rows, "run string, time int, file string, line_no int")).collect()
    for r, n in (("a", 7), ("b", 8), ("c", 30)):
        order = sorted(x[1:] for x in rows if x[0] == r)
        want = [(i + 1, *x) for i, x in enumerate(order) if n <= 7 or i < 3 or i >= n - 3]
        assert sorted((x.i, x.time, x.file, x.line_no) for x in got if x.run == r) == want


def test_csv_order_over_files(spark, tmp_path):
    (tmp_path / "o").mkdir()
    for i in range(5):
        (tmp_path / "o" / f"part-{i}").write_text("".join(f"{k},v{i}_{k}_{j}\n" for j in range(3) for k in range(2)))
    assert {r.gid: r.owner for r in files.load_owners(spark, str(tmp_path / "o")).collect()} == {0: "v4_0_2", 1: "v4_1_2"}


def test_log_minutes_tells_every_minute_of_unordered_files(spark, tmp_path):
    flags = {c: 1 for c in ("opens", "reads", "closes", "stats", "writes")}
    for i, hour in enumerate([9, 1, 5, 0, 7, 3, 8, 2, 6]):
        rows = [(f"r{k % 2}", datetime.datetime(2024, 1, 1, hour, k % 40), *flags.values()) for k in range(60)]
        spark.createDataFrame(rows, f"run string, ts timestamp, {', '.join(f'{c} int' for c in flags)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = jobs.run_log_minutes(stream, str(tmp_path / "out"), str(tmp_path / "at"))
    events.createOrReplaceTempView("minute_events")
    want = spark.sql("SELECT run, date_trunc('MINUTE', ts) AS minute, sum(opens + reads + closes + stats + writes) AS calls, count(*) AS events FROM minute_events GROUP BY 1, 2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_sessions_are_merged_from_a_table(spark, tmp_path):
    for i in range(3):
        rows = [(f"u{k % 2}", "s1", '{"byUser":true}' if k % 3 else "{}", 10 * i + k) for k in range(6)]
        spark.createDataFrame(rows, "user string, session string, state string, time int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.run_ui_sessions(stream, str(tmp_path / "out"), str(tmp_path / "at"))
    assert (tmp_path / "out").exists()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, logs.sessions(events).collect()))


def test_one_point_for_each_date(spark):
    points = spark.createDataFrame([(1, "/a/", 5, 10, 1, "old"), (1, "/a/", 5, 20, 0, "new"), (1, "/a/", 6, 1, 1, None), (2, "/a/", 5, None, 1, "x"), (2, "/a/", 5, None, 1, "x")], "gid long, mount_path string, date long, usage_size long, usage_inodes long, x string")
    assert sorted(tuple(r) for r in usage.one_per_date(points).collect()) == [(1, "/a/", 5, 20, 0, "new"), (1, "/a/", 6, 1, 1, None), (2, "/a/", 5, None, 1, "x")]
