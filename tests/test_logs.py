"""Log files in blocks and in batches against plain passes over their lines."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dirlens.operators import filters, logs, tree, usage
from dirlens.sources import files
from dirlens.streaming import jobs

LINES = "run string, file string, line_no long, value string"


def _lines(n, seed=5):
    rng, out, time = random.Random(seed), [], 1_700_000_000
    for i in range(n):
        time += rng.choice([0, 0, 5, 30, 61, 400])
        host = f" host=h{rng.randint(0, 3)}" if rng.random() < 0.03 else ""
        stamp = f"t={_iso(time)} lvl={'eror' if rng.random() < 0.05 else 'info'}"
        out.append(("r1", "walk", i, f"{stamp} msg=syscalls file=/p/f{rng.randint(0, 1)}{host} opens={rng.randint(0, 9)} bytes={rng.randint(0, 500)} writeBytes=7"))
    return out


def _iso(time):
    from datetime import UTC, datetime

    return datetime.fromtimestamp(time, UTC).strftime("%Y-%m-%dT%H:%M:%S+0000")


def _plain(rows):
    """Hosts by line, and the rates of opens and bytes by minute."""
    events, host, last, rates = [], {}, {}, defaultdict(lambda: [0.0, 0.0])
    for _, _, i, value in rows:
        kv = dict(x.split("=", 1) for x in value.split(" "))
        if kv["lvl"] == "eror":
            continue
        from datetime import datetime

        file, time = kv["file"].rsplit("/", 1)[1], int(datetime.strptime(kv["t"], "%Y-%m-%dT%H:%M:%S%z").timestamp())
        host[file] = kv.get("host", host.get(file))
        events.append((i, file, host[file]))
        now = time // 60
        first = min(now, last.get(file, now - 1) + 1)
        last[file] = now
        for m in range(first, now + 1):
            rates[m][0] += int(kv["opens"]) / (now - first + 1)
            rates[m][1] += int(kv["bytes"]) / (now - first + 1)
    return events, rates


@pytest.mark.parametrize("block", [1, 7, 1 << 14])
def test_hosts_over_blocks_of_lines(spark, monkeypatch, block):
    monkeypatch.setattr(logs, "BLOCK", block)
    rows = _lines(300)
    got = logs.events(logs.parse(spark.createDataFrame(rows, LINES).repartition(5))).select("line_no", "file", "host").collect()
    assert sorted(map(tuple, got)) == sorted(_plain(rows)[0])


def _same_rates(got, rates):
    got = {r.minute: (round(r.opens, 6), round(r.bytes, 6)) for r in got}
    assert set(got) == set(range(min(rates), max(rates) + 1))
    assert all(v == (pytest.approx(rates[m][0], abs=1e-5), pytest.approx(rates[m][1], abs=1e-5)) for m, v in got.items())


def test_rates_of_each_counter(spark):
    rows = _lines(300)
    ev = logs.events(logs.parse(spark.createDataFrame(rows, LINES).repartition(5)))
    _same_rates(logs.minute_rates(ev).collect(), _plain(rows)[1])
    # sums of parts of the events merge into those of the whole
    parts = logs.by_minute(ev.where("line_no % 2 = 0")).unionByName(logs.by_minute(ev.where("line_no % 2 = 1")))
    _same_rates(logs.spread(logs.merged_minutes(parts)).collect(), _plain(rows)[1])


def test_rates_of_a_stream_in_batches(spark, tmp_path):
    """Hosts and previous events are carried from batch to batch; a batch that runs again changes nothing."""
    rows = _lines(240)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for a, b in ((0, 90), (90, 100), (100, 240)):
        spark.createDataFrame(rows[a:b], LINES).coalesce(1).write.mode("append").parquet(source)
        jobs.log_rates(spark.readStream.schema(LINES).parquet(source), out, mark).awaitTermination()
    _same_rates(jobs.read_log_rates(spark, out).collect(), _plain(rows)[1])
    hosts = defaultdict(float)
    for (_, _, h), r in zip(_plain(rows)[0], [v for v in rows if "lvl=info" in v[3]], strict=True):
        hosts[h] += int(r[3].split("opens=")[1].split(" ")[0])
    told = jobs.read_log_rates(spark, out, ("run", "host")).groupBy("host").agg(F.sum("opens").alias("n")).collect()
    assert {r.host: round(r.n, 5) for r in told} == hosts


def test_ui_batches_and_intake(spark, tmp_path):
    path = str(tmp_path / "ui")
    events = spark.createDataFrame([("u", "", "{}", 5), ("u", "é" * 9, "{}", 6), ("u", "s" * 20, "{}", 90_000)], "user string, session string, state string, time long")
    for batch in (1, 1, 2):
        files.append_ui_events(events, path, batch)
    got = sorted((r.session, r.time) for r in files.scan_ui_events(spark, path).collect())
    assert got == sorted([("é" * 7, 6), ("s" * 14, 90_000)] * 2)
    assert files.scan_ui_events(spark, path, 0, 100).count() == 2
    with pytest.raises(ValueError, match="range"):
        files.scan_ui_events(spark, path, 10, 9)


def test_stated_errors(spark):
    history = spark.createDataFrame([(1, "/a/", 5)], "gid long, mount_path string, date long")
    assert usage.history_of(history, 1, "/a/b/").count() == 1
    with pytest.raises(ValueError, match="no history"):
        usage.history_of(history, 1, "/b/")
    summary = spark.createDataFrame([("/", 1), ("/a/", 1)], "dir string, count long")
    assert tree.dir_info(summary.where("dir = 'none'"), "/a/", summary).count() == 0
    with pytest.raises(ValueError, match="no such directory"):
        tree.dir_info(summary, "/c/", summary)
    with pytest.raises(ValueError, match="no such view"):
        filters.usage_filter("x", 0)


def test_table_filter_and_rights(spark):
    rows = spark.createDataFrame([("a", 1, [1, 2]), ("b", 5, [3]), ("c", 9, [])], "user string, n long, gids array<long>")
    kept = lambda **w: sorted(r.user for r in rows.where(filters.table_filter(w)).collect())
    assert kept(n=filters.Range(1, 5)) == ["a", "b"] and kept(n=filters.Range(5)) == ["b", "c"] and kept(n=filters.Range()) == ["a", "b", "c"]
    assert kept(user=[]) == ["a", "b", "c"] and kept(user=["a", "c"], n=filters.Range(None, 3)) == ["a"]
    assert kept(gids=filters.AnyOf((2, 3))) == ["a", "b"] and kept(gids=filters.AnyOf(())) == ["a", "b", "c"] and kept(n=lambda c: c % 3 == 0) == ["c"]
    members = spark.createDataFrame([("a", 2), ("a", 7), ("b", 9), ("c", 7)], "user string, gid long")
    seen = lambda listed: sorted(r.user for r in filters.authorised(rows, filters.rights(members, spark.createDataFrame([(g,) for g in listed], "gid long")), "gids").collect())
    assert seen([]) == ["a"] and seen([9]) == ["a", "b"] and seen([7]) == ["a", "c"]


def test_one_history_point_of_a_date(spark, tmp_path):
    """In a stored table and in a stream: of two points of one date the one of more usage."""
    schema = "gid long, mount_path string, date long, usage_size long, quota_size long, usage_inodes long, quota_inodes long"
    points = spark.createDataFrame([(1, "/a/", 5, 10, 1, 2, 1), (1, "/a/", 5, 30, 1, 2, 1), (1, "/a/", 6, 1, 1, 1, 1)], schema)
    want = [(1, "/a/", 5, 30, 1, 2, 1), (1, "/a/", 6, 1, 1, 1, 1)]
    empty = spark.createDataFrame([], "mount_path string, kind string, age int, id long")
    for _ in range(2):
        files.write_basedirs(str(tmp_path / "b"), empty, empty, points)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "b/history")).collect())) == want
    points.write.parquet(str(tmp_path / "in"))
    jobs.append_history(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/points")).drop("batch").collect())) == want


def test_percentiles_by_rank(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, *range(40)])) for k in "ab" for _ in range(301)] + [("c", 4)]
    from dirlens.operators.basedirs import nearest_rank

    got = {r.k: (r.p50, r.p95, r.p99, r.n) for r in nearest_rank(spark.createDataFrame(rows, "k string, v long"), ["k"], "v").collect()}
    for k in "abc":
        v = sorted(x for key, x in rows if key == k and x is not None)
        assert got[k] == (*[v[-(-len(v) * p // 100) - 1] for p in (50, 95, 99)], len(v))


def test_lines_are_matched_once(spark):
    """Keys and values come of one match of a line; keys and values of odd lines are as they were."""
    lines = spark.createDataFrame([('t=1 msg="a \\"b\\" =c" k= k=2 x==y z', )], "value string")
    parsed = logs.parse(lines)
    assert parsed.columns == ["value", "kv"] and parsed.first().kv == {"t": "1", "msg": 'a "b" =c', "k": "2", "x": "=y"}
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
