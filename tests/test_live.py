"""The live table: batches merge, versions replace, readers finish, batches cost alike, folders go."""

import os

import pytest
from pyspark.sql import functions as F

from dirlens.streaming import live

SCHEMA = "mount_path string, version int, uid int"


@pytest.fixture
def feed(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in "soc")

    def run(rows, grace=live.GRACE, merged=None, mark=mark):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        partial = lambda r: r.groupBy("mount_path", "version", "uid").agg(F.count("*").alias("n"))

        def merge(p):
            if merged is not None:
                merged.append(len(p.inputFiles()))
            return p.groupBy("mount_path", "uid").agg(F.sum("n").alias("n"))

        live.ingest(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), partial, merge, out, mark, grace).awaitTermination()
        return {(r.mount_path, r.uid): r.n for r in live.read_ingested(spark, out).collect()}

    run.out = out
    return run


def test_batches_merge_and_versions_replace(feed):
    batches = [[("/a/", 1, 1), ("/a/", 1, 2)], [("/a/", 1, 1), ("/b/", 5, 9)], [("/a/", 2, 7)], [("/a/", 2, 7), ("/a/", 1, 1)], [("/a/", 1, 1)], [], [(None, 1, 1), ("/c/", None, 1)]]
    want = [{("/a/", 1): 1, ("/a/", 2): 1}, {("/a/", 1): 2, ("/a/", 2): 1, ("/b/", 9): 1}, {("/a/", 7): 1, ("/b/", 9): 1}] + 4 * [{("/a/", 7): 2, ("/b/", 9): 1}]
    assert [feed(rows) for rows in batches] == want


def test_a_version_may_span_batches_with_an_older_one_between(feed):
    assert feed([("/a/", 3, 1)]) and feed([("/a/", 2, 5), ("/a/", 3, 1)]) == {("/a/", 1): 2}


def test_cost_is_flat_and_superseded_folders_go(feed):
    merged = []
    for i in range(6):
        assert feed([("/a/", 1, 1), ("/b/", i, 2)], 0, merged)[("/a/", 1)] == i + 1
    assert max(merged[1:]) <= merged[1]
    assert len(os.listdir(f"{feed.out}/data")) <= 2 and not os.listdir(f"{feed.out}/parts")
    assert len([n for n in os.listdir(f"{feed.out}/live") if n.startswith("batch=")]) <= live.LISTS


def test_a_reader_from_before_a_swap_finishes(spark, feed):
    feed([("/a/", 1, 1)])
    before = live.read_ingested(spark, feed.out)
    assert feed([("/a/", 2, 2), ("/a/", 2, 3)]) == {("/a/", 2): 1, ("/a/", 3): 1}
    assert [r.uid for r in before.collect()] == [1]


def test_a_repeated_batch_changes_nothing(spark, feed, tmp_path):
    feed([("/a/", 1, 1)])
    now = feed([("/a/", 1, 1)])
    os.remove(tmp_path / "c" / "commits" / "1")  # as if lost after the list was published
    for crc in (tmp_path / "c" / "commits").glob(".1.crc"):
        crc.unlink()
    assert feed([("/b/", 1, 4)]) == now | {("/b/", 4): 1}


def test_errors(spark, feed, tmp_path):
    with pytest.raises(ValueError, match="nothing was published"):
        live.read_ingested(spark, str(tmp_path / "none"))
    feed([("/a/", 1, 1)])
    with pytest.raises(ValueError, match="belongs to the checkpoint"):
        feed([("/a/", 1, 1)], mark=str(tmp_path / "other"))
