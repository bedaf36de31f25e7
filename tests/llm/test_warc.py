import hashlib
import io
import zipfile

import pytest

from dirlens.llm import warc as W

LONG = "<html>é " + "x" * 120


def _pages(spark):
    rows = [(5, "http://a/1", LONG), (3, "http://a/2 b\n", LONG), (9, None, LONG), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", LONG), (10, "u", LONG + "!"), (5, "http://a/1", LONG), (11, "u", "y" * 300000)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_round_trip(spark, size):
    rows, pages = _pages(spark)
    packs = W.write_packages(pages, package_bytes=size)
    got = W.read_packages(packs, payloads=True).collect()
    assert len(got) == len(rows) == sum(r.records for r in packs.collect())
    for r in got:
        text = next(h for p, _, h in rows if p == r.page_id) or ""
        data = text.encode()
        first = min((p for p, _, h in rows if h == text and p is not None), default=None) if len(data) >= 100 else r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert r.payload == (data if r.record_type == "response" else None)


def test_many_tasks_read_one_package(spark, monkeypatch):
    monkeypatch.setattr(W, "RANGE", 2000)
    monkeypatch.setattr(W, "TASK_BYTES", 4000)
    rows = [(i, f"http://a/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 9) for i in range(400)]
    packs = W.write_packages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert packs.count() == 1
    got = W.read_packages(packs)
    assert got.rdd.getNumPartitions() >= 20 and {r.page_id for r in got.collect()} == set(range(400))


def test_no_rows(spark):
    _, pages = _pages(spark)
    assert W.read_packages(W.write_packages(pages.limit(0))).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_directory_as_the_standard_library_reads_it(monkeypatch, wide):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"hello world, hello")
        z.writestr("ü/b", b"second member here")
        z.comment = b"a comment" + b"c" * 40
    data = out.getvalue()
    if wide:
        assert b"PK\x06\x06" in data
    read_at = lambda n, at: data[at : at + n]
    got = W.members(read_at, len(data))
    with zipfile.ZipFile(out) as z:
        assert [(i.filename, i.compress_type, i.header_offset, i.compress_size) for i in z.infolist()] == got
    for (_, _, header, n), want in zip(got, [b"hello world, hello", b"second member here"], strict=True):
        assert read_at(n, W.data_offset(read_at, header)) == want


def test_archive_without_an_index():
    import gzip

    recs = [gzip.compress(W.record(i, "u", b"p" * i * 1000, hashlib.sha256(b"p" * i * 1000).hexdigest(), None)) for i in range(1, 5)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/x.warc.gz", b"".join(recs))
    data = out.getvalue()
    found = list(W.entries(lambda n, at: data[at : at + n], len(data)))
    assert [W.parse(gzip.decompress(data[a : a + n]))["page_id"] for a, n in found] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        W.members(lambda n, at: b"nothing"[at : at + n], 7)
