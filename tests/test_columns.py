import pytest
from pyspark.sql import functions as F

from dirlens.functions import ages, filetypes, formats, paths


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_file_types(spark):
    want = {"a.bam": 32, "A.CRAM": 64, "x.vcf.gz": 4, "x.vcf": 2, "x.bcf": 8, "r.fq.gz": 512, "r.fastq": 256, "s.fa": 128, "nofa": 32768, "b.bim": 1024, "t.tar.gz": 2048, "readme": 4096, "README": 4096, "z.csv": 4096, "run.oe": 8192, "d/": 16384, "plain": 32768, "a.sam": 16}
    got = spark.createDataFrame([(k,) for k in want], "n string").select("n", filetypes.file_type(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in got} == want
    assert one(spark, filetypes.file_type(F.lit("nofa"), compat=True)) == (0,)


def test_temporary_names(spark):
    for name, temp in {"tmp.a": True, ".tmp.a": True, "TEMP.x": True, "tmp/": True, "a.tmp": True, "a.temp/": True, "template": False, "atmp": False, "tmpx/": False}.items():
        assert one(spark, filetypes.is_temp(F.lit(name))) == (temp,), name
    assert one(spark, filetypes.in_temp_dir(F.lit("/a/tmp/b/")), filetypes.in_temp_dir(F.lit("/a/b/"))) == (True, False)
    with pytest.raises(Exception, match="unknown file type"):
        one(spark, filetypes.names_mask(F.array(F.lit("nonsense"))))


def test_paths(spark):
    p = F.lit("/a/b/c.txt")
    assert one(spark, paths.basename(p), paths.parent(p, F.lit("f")), paths.depth(F.lit("/a/b/")), paths.depth(F.lit("/")), paths.split_keep(p), paths.ancestors(F.lit("/a/b/"))) == ("c.txt", "/a/b/", 2, 0, ["a/", "b/", "c.txt"], ["/", "/a/", "/a/b/"])
    assert one(spark, paths.normalise(F.lit(" a/b ")), paths.parent_dir(F.lit("/a/b/")), paths.parent_dir(F.lit("/"))) == ("/a/b/", "/a/", None)
    assert one(spark, *[paths.mount_from_name(F.lit(n)) for n in ("12_／lustre／a", "noname")]) == ("/lustre/a/", "/")
    assert one(spark, *[paths.unquote(F.lit(q)) for q in ('"a b"', r'"t\tq\"x"', r'"\xc3\xa9é"', r'"\x4F"')]) == ("a b", 't\tq"x', "éé", "O")


def test_ages(spark):
    ref = 1_700_000_000
    t = lambda months: F.lit(ref - months * ages.MONTH)
    assert one(spark, ages.level(t(0), ref), ages.level(t(1), ref), ages.level(t(24), ref), ages.level(t(100), ref)) == (0, 1, 5, 8)
    assert one(spark, ages.codes(F.lit(2), F.lit(1))) == ([0, 1, 2, 9],)
    assert one(spark, *[ages.bucket(F.lit(ref - d * 86400), ref) for d in (0, 30, 60, 180, 365, 7 * 365)], ages.bucket(F.lit(0), ref)) == (8, 7, 6, 5, 4, 0, None)
    assert one(spark, *[ages.age_from_code(F.lit(c)) for c in ("0", "16", "A1M", "M7Y", "2M")]) == (0, 16, 1, 16, 2)
    with pytest.raises(Exception, match="invalid age"):
        one(spark, ages.age_from_code(F.lit("17")))


def test_formats(spark):
    assert one(spark, formats.size_from_text(F.lit("50M")), formats.size_text(F.lit(1536)), formats.days_ago(F.lit(0), 86_400 * 3 + 5), formats.days_ago(F.lit(10), 5), formats.time_ago(F.lit(0), 3 * 86400), formats.time_ago(F.lit(0), 60)) == (50 * 1024**2, "1.50 KiB", 3, 0, "~ 3 days ago", "~ 1 minute ago")
    assert one(spark, *[F.round(formats.percent_of(F.lit(n), F.lit(10000)) * 100).cast("long") for n in (29, 57, 58, 115)]) == (29, 57, 58, 115)
    assert one(spark, formats.iso_time(F.lit(0)), formats.quota_status(F.lit(None).cast("long"), F.lit(3 * 86400), 0), formats.quota_status(F.lit(None).cast("long"), F.lit(3 * 86400 + 1), 0)) == ("1970-01-01T00:00:00Z", "Not OK", "OK")
    assert one(spark, formats.percent_of(F.lit(1), F.lit(3)), formats.percent_of(F.lit(1), F.lit(0))) == (33.33, None)
