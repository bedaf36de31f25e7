"""Cases whose values are fixed by the formats and rules that this engine shares with its predecessor."""

import pytest
from pyspark.sql import functions as F

from dirlens.functions import filetypes
from dirlens.operators import basedirs, globs, logs, usage
from dirlens.sources import files

# Globs and, for paths, the number of the glob that wins (None: no group).
GLOBS = [
    "/some/path/**", "/some/path/temp-**", "/some/path/noBackup/**", "/some/other/path/**.txt", "/some/other/path/**.tsv*",
    "/some/other/path/b/**.other", "/some/other/path/b/c/**", "/some/other/path/b/c/", "/some/test/path/b/**.cram",
    "/some/test/path/b/c/**cram", "/some/test/path/b/e/**cram", "/some/test/path/b/e/**.cram", "/some/test/path/**",
    "/path/dir/a/**.txt", "/path/dir/a/*.txt", "/path/dir/b/*.txt", "/path/dir/c/*/*/*.txt",
]
PATHS = {
    "/some/path": None,
    "/some/otherPath/": None,
    "/some/path/": 0,
    "/some/path/file": 0,
    "/some/path/temp-file": 1,
    "/some/path/noBackup": 0,
    "/some/path/noBackup/": 2,
    "/some/path/noBackup/someFile": 2,
    "/some/other/path/file": None,
    "/some/other/path/.txt": 3,
    "/some/other/path/file.txt": 3,
    "/some/other/path/b/file.txt": 3,
    "/some/other/path/file.txta.txt": 3,
    "/some/other/path/subdir/file.txt": 3,
    "/some/other/path/subdir/file.txts": None,
    "/some/other/path/subdir/.tsv": 4,
    "/some/other/path/subdir/b.tsv": 4,
    "/some/other/path/subdir/b.tsvs": 4,
    "/some/other/path/subdir/file.tsv.txt": 4,
    "/some/other/path/subdir/file.txta.tsv": 4,
    "/some/other/path/file.tx.txt": 3,
    "/some/other/path/file.txt.txt": 3,
    "/some/other/path/subdir/file.txt.tsv": 4,
    "/some/other/path/b/c/*.other": 6,
    "/some/other/path/b/c/": 7,
    "/some/test/path/b/d/a.cram": 8,
    "/some/test/path/b/e/acram": 10,
    "/some/test/path/b/e/a.cram": 11,
    "/some/test/path/b/e/a": 12,
    "/some/test/path/b/e/a.": 12,
    "/some/test/path/b/e/a.c": 12,
    "/some/test/path/b/e/a.cr": 12,
    "/some/test/path/b/e/a.cra": 12,
    "/path/dir/a/b.txt": 14,
    "/path/dir/a/b/c.txt": 13,
    "/path/dir/b/c.txt": 15,
    "/path/dir/b/c/d.txt": None,
    "/path/dir/c/d.txt": None,
    "/path/dir/c/d/e.txt": None,
    "/path/dir/c/d/e/f.txt": 16,
    "/path/dir/c/d/e/f/g.txt": None,
}


def test_globs(spark):
    rules = spark.createDataFrame([(g, str(i)) for i, g in enumerate(GLOBS)], "glob string, group_name string")
    got = globs.glob_group(spark.createDataFrame([(p,) for p in PATHS], "path string"), rules).collect()
    assert {r.path: r.glob_group and int(r.glob_group) for r in got} == PATHS


HOUR, NOW, MOST = 3600, 1_700_000_000, 1_000_000
SIX_YEARS, FOUR_YEARS = (int(2 * (MOST - 1) / (n * 365)) for n in (6, 4))
# Points (hours ago, size, its quota, inodes, their quota) and when the quotas are full (hours from now).
FORECASTS = {
    "one point": ([(0, 2, 10, 1, 20)], None, None),
    "one point, full": ([(0, 10, 10, 20, 20)], 0, 0),
    "one point, more than full": ([(0, 20, 10, 30, 20)], 0, 0),
    "two points": ([(24, 5, 100, 0, 20), (0, 20, 100, 10, 20)], 24 * 5 + 8, 24),
    "no change in size, inodes full": ([(25, 5, 100, 0, 20), (0, 5, 100, 20, 20)], None, 0),
    "downward": ([(24, 50, 100, 50, 20), (0, 10, 100, 0, 20)], None, None),
    "last and third from last": ([(48, 0, 100, 0, 20), (24, 5, 100, 5, 20), (0, 5, 100, 10, 20)], 24 * 38, 24 * 2),
    "of four": ([(72, 100, 100, 100, 20), (48, 0, 100, 0, 20), (24, 5, 100, 5, 20), (0, 5, 100, 10, 20)], 24 * 38, 24 * 2),
    "more than five years": ([(48, 1, MOST, 1, MOST), (24, 1, MOST, 1, MOST), (0, SIX_YEARS, MOST, FOUR_YEARS, MOST)], None, 24 * 4 * 365),
}


def test_forecasts(spark):
    names = list(FORECASTS)
    rows = [(g, "/m/", NOW - h * HOUR, s, sq, i, iq) for g, n in enumerate(names) for h, s, sq, i, iq in FORECASTS[n][0]]
    h = spark.createDataFrame(rows, "gid long, mount_path string, date long, usage_size long, quota_size long, usage_inodes long, quota_inodes long")
    got = {names[r.gid]: (r.date_no_space, r.date_no_files) for r in usage.quota_forecast(h, NOW).collect()}
    for name, (_, *want) in FORECASTS.items():
        for date, hours in zip(got[name], want, strict=True):
            margin = 15_000 if hours and hours > 3 * 365 * 24 else 2
            assert date == (hours if hours is None else pytest.approx(NOW + hours * HOUR, abs=margin)), name
    assert usage.quota_forecast(h.limit(0), NOW).count() == 0


# File names of each type, and names that are not of it.
TYPES = {
    "vcf": (["bar.vcf", "bar.VCF"], ["vcf.bar", "bar.fcv"]),
    "vcf.gz": (["bar.vcf.gz"], ["vcf.gz.bar", "bar.vcf"]),
    "bcf": (["bar.bcf"], ["bcf.bar", "bar.vcf"]),
    "sam": (["bar.sam"], ["bar.bam"]),
    "bam": (["bar.bam"], ["bar.sam"]),
    "cram": (["bar.cram"], ["bar.bam"]),
    "fasta": (["bar.fasta", "bar.fa"], ["bar.fastq"]),
    "fastq": (["bar.fastq", "bar.fq"], ["bar.fasta", "bar.fastq.gz"]),
    "fastq.gz": (["bar.fastq.gz", "bar.fq.gz"], ["bar.fastq", "bar.fq"]),
    "ped/bed": (["bar.ped", "bar.map", "bar.bed", "bar.bim", "bar.fam"], ["bar.asd"]),
    "compressed": (["bar.bzip2", "bar.gz", "bar.tgz", "bar.zip", "bar.xz", "bar.bgz"], ["bar.bcf", "bar.asd", "bar.vcf.gz", "bar.fastq.gz"]),
    "text": (["bar.csv", "bar.tsv", "bar.txt", "bar.text", "bar.md", "bar.dat", "bar.README", "READme"], ["bar.sam", "bar.out", "bar.asd"]),
    "log": (["bar.log", "bar.o", "bar.out", "bar.e", "bar.err", "bar.oe"], ["bar.txt", "bar.asd"]),
    "other": (["bar.asd", ".tmp.asd", ".tmp"], []),
    "dir": (["path/"], []),
}
TEMPORARY = [".tmp.cram", "tmp.cram", ".temp.cram", "temp.cram", "a.cram.tmp", "a.cram.temp"]
NOT_TEMPORARY = ["xtmp.cram", "tmpx.cram", "xtemp.cram", "tempx.cram", "xtmp", "xtemp"]
TEMPORARY_DIRS = {"/foo/tmp/": True, "/foo/temp/": True, "/foo/TEMP/": True, "/foo/": False}


def test_file_types(spark):
    bits = {n: b for b, n in filetypes.NAMES.items()}
    names = sorted({n for yes, no in TYPES.values() for n in (*yes, *no)})
    got = {r.n: r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", filetypes.file_type(F.col("n")).alias("t")).collect()}
    for kind, (yes, no) in TYPES.items():
        assert all(got[n] == bits[kind] for n in yes) and all(got[n] != bits[kind] for n in no), kind
    temp = spark.createDataFrame([(n, n in TEMPORARY) for n in TEMPORARY + NOT_TEMPORARY], "n string, want boolean")
    assert temp.where(filetypes.is_temp(F.col("n")) != F.col("want")).count() == 0
    dirs = spark.createDataFrame(list(TEMPORARY_DIRS.items()), "d string, want boolean")
    assert dirs.where(filetypes.in_temp_dir(F.col("d")) != F.col("want")).count() == 0


def test_rules(spark):
    """A unit is a directory at the depth that its own rule asks for; a rule's last component may be a beginning."""
    rules = spark.createDataFrame([("/some/partial/thing", 3), ("/ab/cd/", 3), ("/ab/ef/", 0)], "prefix string, mindirs int")
    want = {"/ab/cd/ef/": True, "/ab/cd/ef/g/h/": False, "/some/partial/thing/": True, "/some/partial/thingCat/": True, "/some/partial/think/": False}
    dirs = spark.createDataFrame([(d, d.count("/") - 1) for d in want], "dir string, depth int")
    got = {r.dir for r in basedirs.rule_for(dirs, rules).where("depth = mindirs").collect()}
    assert got == {d for d, ok in want.items() if ok}


def test_duplicates_report(spark, tmp_path):
    files_ = [("teamA/user1/bFile.txt", 200, 0), ("teamB/user2/aFile.txt", 400, 0), ("teamA/user1/aFile.txt", 300, 1), ("teamA/user2/aFile.txt", 300, 3), ("teamA/user3/cFile.txt", 300, 1), ("teamB/user3/cFile.txt", 400, 2)]
    rows = [(f"/opt/teams/{p}", n, n, i, "f") for p, n, i in files_]
    sets = basedirs.dupes_by_size(spark.createDataFrame(rows, "path string, size long, apparent_size long, inode long, entry_type string"), 0, F.lit(0))
    files.write_dupes(sets.coalesce(1), str(tmp_path / "d"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*")))
    assert text == (
        'Size: 300\n"/opt/teams/teamA/user1/aFile.txt"\n\t"/opt/teams/teamA/user3/cFile.txt"\n"/opt/teams/teamA/user2/aFile.txt"\n'
        'Size: 400\n"/opt/teams/teamB/user2/aFile.txt"\n"/opt/teams/teamB/user3/cFile.txt"\n'
    )


T = "1970-01-02T10:17:3"  # and a digit: 123456 seconds and more
# Lines of a log, and its events and errors as (time, file, host, what else).
LINES = [
    ("", [], []),
    (f"t={T}6+0000 ", [(123456, "log", None, {})], []),
    (f"t={T}6+0000 msg=something", [], []),
    (f"t={T}6+0000 msg=syscalls", [(123456, "log", None, {})], []),
    (f't={T}6+0000 msg="syscall logging"', [(123456, "log", None, {})], []),
    ("file=/path/to/something.1", [(None, "something.1", None, {})], []),
    ("host=abc", [(None, "log", "abc", {})], []),
    *[(f"{k}=123", [(None, "log", None, {k: 123})], []) for k in ("opens", "reads", "bytes", "closes", "stats")],
    ("lvl=eror", [], [(None, "log", None, None, {})]),
    (f"t={T}6+0000 lvl=eror", [], [(123456, "log", None, None, {})]),
    ('lvl=eror msg="an error"', [], [(None, "log", None, "an error", {})]),
    ('lvl=eror arg1=something arg2="something else"', [], [(None, "log", None, None, {"arg1": "something", "arg2": "something else"})]),
    (f"t={T}6+0000 host=abc\nt={T}7+0000 opens=1", [(123456, "log", "abc", {}), (123457, "log", "abc", {"opens": 1})], []),
    (f"t={T}6+0000 host=abc\nt={T}7+0000 lvl=eror msg=abc", [(123456, "log", "abc", {})], [(123457, "log", "abc", "abc", {})]),
    (
        f"t={T}6+0000 file=a host=abc\nt={T}7+0000 file=b host=def\nt={T}8+0000 lvl=eror msg=abc\nt={T}9+0000 file=a opens=1",
        [(123456, "a", "abc", {}), (123457, "b", "def", {}), (123459, "a", "abc", {"opens": 1})],
        [(123458, "log", None, "abc", {})],
    ),
]


def test_log_lines(spark):
    rows = [(str(i), "log", n, line) for i, (text, _, _) in enumerate(LINES) for n, line in enumerate(text.split("\n"))]
    parsed = logs.parse(spark.createDataFrame(rows, "run string, file string, line_no long, value string"))
    events, errors = logs.events(parsed).orderBy("line_no").collect(), logs.errors(parsed).orderBy("line_no").collect()
    for i, (text, want, bad) in enumerate(LINES):
        assert [(r.time, r.file, r.host, {c: r[c] for c in logs.COUNTERS if r[c] is not None}) for r in events if r.run == str(i)] == want, text
        assert [(r.time, r.file, r.host, r.message, r.data) for r in errors if r.run == str(i)] == bad, text
