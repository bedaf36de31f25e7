"""Closed forms against plain recursion and incremental merging on random trees."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dirlens.operators import basedirs, globs, rollup, tree, usage
from dirlens.sources import files


def _random_dirs(rng):
    dirs = ["/"]
    for _ in range(rng.randint(1, 14)):
        dirs.append(rng.choice(dirs) + f"{rng.choice('abc')}/")
    return sorted(set(dirs))


def _up(d):
    parts = d.strip("/").split("/") if d != "/" else []
    return ["/"] + ["/" + "/".join(parts[: i + 1]) + "/" for i in range(len(parts))]


def _summary(rng):
    count = defaultdict(int)
    for d in _random_dirs(rng):
        n = rng.choice([0, 0, 1, 2])
        for a in _up(d):
            count[a] += n
    return {d: n for d, n in count.items() if n}


def _kids(s, d):
    return [k for k in s if k != "/" and k.rsplit("/", 2)[0] + "/" == d]


def _where(s, d, splits):
    while len(_kids(s, d)) == 1 and s[_kids(s, d)[0]] == s[d]:
        d = _kids(s, d)[0]
    out = [d]
    if splits:
        for k in _kids(s, d):
            out += _where(s, k, splits - 1)
    return out


def _locations(s, d):
    kids = _kids(s, d)
    return [d] if sum(s[k] for k in kids) < s[d] else [x for k in kids for x in _locations(s, k)]


def test_where_and_locations_equal_recursion(spark):
    rng, trees = random.Random(7), []
    for _ in range(12):
        s = _summary(rng)
        if s:
            trees.append(s)
    for s in trees:
        df = spark.createDataFrame(list(s.items()), "dir string, count long").coalesce(1)
        for splits in (0, 1, 3):
            assert sorted(r.dir for r in tree.where(df, "/", splits).collect()) == sorted(_where(s, "/", splits))
        assert sorted(r.dir for r in tree.file_locations(df, "/").collect()) == sorted(_locations(s, "/"))


STATS = "path string, size long, uid long, gid long, atime long, mtime long, ctime long, entry_type string, inode long, nlink long, device long, apparent_size long"


def _files(rng, n=60):
    rows = []
    for i in range(n):
        d = rng.choice(_random_dirs(rng))
        linked = rng.random() < 0.4
        rows.append((f"{d}f{i}{rng.choice(['.bam', '.txt', '.tmp'])}", rng.randint(1, 99), rng.randint(0, 2), rng.randint(0, 1), rng.randint(1, 10**9), rng.randint(1, 10**9), 0, "f", rng.randint(1, 8) if linked else i + 100, 2 if linked else 1, 0, 7))
    return rows


def test_hardlinks_merge_per_ancestor(spark):
    rows = _files(random.Random(3))
    got = {(r.dir, r.inode): (r.size, r.atime, r.mtime, r.gid, r.uid) for r in rollup.hardlink_entries(rollup.enriched(spark.createDataFrame(rows, STATS), 10**9)).collect()}
    want = {}
    for p, size, uid, gid, a, m, *_, inode, nlink, _, _ in sorted(rows):
        if nlink > 1:
            for d in _up(p.rsplit("/", 1)[0] + "/"):
                s0, a0, m0, g, u = want.get((d, inode), (0, 10**18, 0, gid, uid))
                want[d, inode] = (max(size, s0), min(a, a0), max(m, m0), g, u)
    assert got == want


def test_base_directory_holds_all_and_is_deepest(spark):
    rows = _files(random.Random(5), 80)
    rules = spark.createDataFrame([("/", 1)], "prefix string, mindirs int")
    leaf = basedirs.unit_files(spark.createDataFrame(rows, STATS), rules, 10**9)
    got = {(r.id, r.unit): (r.basedir, r["count"]) for r in basedirs.basedirs(leaf, "gid").where("age = 0").collect()}
    want, seen = defaultdict(list), set()
    for r in sorted(rows):
        d = r[0].rsplit("/", 1)[0] + "/"
        if d != "/" and not (r[9] > 1 and (d, r[8]) in seen):
            seen.add((d, r[8]))
            want[r[3], "/" + d.split("/")[1] + "/"].append(d)
    assert got == {k: (max((a for a in _up(v[0]) if all(x.startswith(a) for x in v)), key=len), len(v)) for k, v in want.items()}


def test_glob_precedence(spark):
    rules = [("/a/**", "all"), ("/a/*/c", "star"), ("/a/b/c", "exact"), ("/**.txt", "text"), ("/a/b*", "b")]
    df = spark.createDataFrame([(p,) for p in ("/a/b/c", "/a/x/c", "/a/x/y/c", "/q/r.txt", "/a/x.txt", "/a/bz", "/z")], "path string")
    got = {r.path: r.glob_group for r in globs.glob_group(df, spark.createDataFrame(rules, "glob string, group_name string")).collect()}
    assert got == {"/a/b/c": "exact", "/a/x/c": "star", "/a/x/y/c": "all", "/q/r.txt": "text", "/a/x.txt": "all", "/a/bz": "b", "/z": None}
    with pytest.raises(ValueError, match="ambiguous"):
        globs.glob_group(df, spark.createDataFrame([("/a", "x"), ("/a", "y")], "glob string, group_name string"))


def test_forecasts(spark):
    day, rows = 86400, []
    series = {1: [(0, 10), (10, 20), (20, 30)], 2: [(0, 30), (10, 20)], 3: [(0, 10), (10, 100)], 4: [(0, 0), (5, 1), (10, 1)], 5: [(0, 50), (10, 10), (20, 10), (30, 40)], 6: [(7, 20)]}
    for gid, points in series.items():
        rows += [(gid, "/m/", d * day, u, 100, u, 100) for d, u in points]
    h = spark.createDataFrame(rows, "gid long, mount_path string, date long, usage_size long, quota_size long, usage_inodes long, quota_inodes long")
    got = {r.gid: r.date_no_space for r in usage.quota_forecast(h, 20 * day).collect()}
    assert got == {1: 90 * day, 2: None, 3: 10 * day, 4: 1000 * day, 5: 70 * day, 6: None}
    assert {r.gid for r in usage.history_append(h.where("gid < 3"), h).where("gid = 3").collect()} == {3} and usage.history_append(h, h).count() == len(rows)


def test_unauthorised(spark):
    df = spark.createDataFrame([("/", [1, 2]), ("/a/", [2])], "dir string, gids array<long>")
    assert {r.dir: r.noauth for r in tree.mark_noauth(df, [1]).collect()} == {"/": False, "/a/": True}
    assert not tree.mark_noauth(df, None).where(F.col("noauth")).count()


def _dataset(spark, rows):
    """rows: (mount_path, path, size, time) of user 11 and group 1."""
    zero = F.lit(0).cast("long")
    df = spark.createDataFrame(rows, "mount_path string, path string, size long, atime long")
    more = {"uid": F.lit(11).cast("long"), "gid": F.lit(1).cast("long"), "mtime": F.col("atime"), "ctime": F.col("atime"), "entry_type": F.lit("f"), "inode": zero, "nlink": F.lit(1).cast("long"), "device": zero, "apparent_size": F.col("size")}
    return df.withColumns(more)


def test_tree_over_two_stored_datasets(spark, tmp_path):
    """Directories above both mounts are told as one; fixed values."""
    ref = 20 * 365 * 86400
    for mount, path, time in (("/a/b/c/d/", "/a/b/c/d/file.bam", 20), ("/a/b/c/e/", "/a/b/c/e/file2.bam", 15)):
        files.write_dguta(rollup.dguta(_dataset(spark, [(mount, path, 1, time)]), ref, ("mount_path",)), str(tmp_path / "cube"), F.lit(100 if time == 20 else 200))
    stored = files.union_sources(spark, str(tmp_path / "cube"))
    summary = rollup.dir_summary(rollup.guta_filter(stored, mask=tree.FILES))
    told = lambda df: sorted((r.dir, r["count"], r["size"], r.atime, r.mtime, r.uids, r.gids) for r in df.collect())
    whole = ("/a/b/c/", 2, 2, 15, 20, [11], [1])
    assert told(tree.where(summary, "/", 0)) == [whole]
    assert told(tree.where(summary, "/", 1)) == [whole, ("/a/b/c/d/", 1, 1, 20, 20, [11], [1]), ("/a/b/c/e/", 1, 1, 15, 15, [11], [1])]
    assert told(tree.dir_info(summary, "/a/b/")) == [("/a/b/", 2, 2, 15, 20, [11], [1]), whole]
    assert sorted(map(tuple, files.mount_timestamps(stored).collect())) == [("/a/b/c/d/", 100), ("/a/b/c/e/", 200)]
    # one dataset again, with two files more: the other one's rows of shared directories stay
    again = [("/a/b/c/e/", f"/a/b/c/e/x/{n}.bam", 5, 30) for n in range(3)]
    files.write_dguta(rollup.dguta(_dataset(spark, again), ref, ("mount_path",)), str(tmp_path / "cube"), F.lit(300))
    summary = rollup.dir_summary(rollup.guta_filter(files.union_sources(spark, str(tmp_path / "cube")), mask=tree.FILES))
    assert told(tree.where(summary, "/", 1)) == [("/a/b/c/", 4, 16, 20, 30, [11], [1]), ("/a/b/c/d/", 1, 1, 20, 20, [11], [1]), ("/a/b/c/e/x/", 3, 15, 30, 30, [11], [1])]


def test_merged_cubes_of_datasets_equal_one_cube(spark):
    """Of files without links across datasets, in one listing or in two; but for the directories each of them has."""
    rng = random.Random(4)
    rows = [(f"/{rng.choice('ab')}/", rng.choice(["", "c/", "c/d/", "tmp/"]), f"f{i}{rng.choice(['.bam', '.txt', '.log'])}", rng.randint(1, 99), rng.choice([-5, 0, 10**8, 5 * 10**8])) for i in range(120)]
    df = _dataset(spark, [(m, f"{m}{d}{n}", size, t) for m, d, n, size, t in rows])
    df = df.withColumn("inode", F.when(F.col("size") < 30, F.col("size") + F.when(F.col("mount_path") == "/a/", 1000).otherwise(0)).otherwise(0).cast("long")).withColumn("nlink", F.when(F.col("inode") > 0, 2).otherwise(1).cast("long"))
    ref = 10**9
    told = lambda c: sorted(tuple(r) for r in c.where("ft & 16384 = 0").select("dir", "gid", "uid", "ft", "age", "count", "size", "atime", "mtime", *rollup.HIST).collect())
    one = rollup.dguta(df.drop("mount_path"), ref)
    assert told(rollup.merge_cubes(rollup.dguta(df, ref, ("mount_path",)))) == told(one)


def test_summaries_and_levels_equal_the_cube(spark):
    """Without the cube between; and stored levels of datasets give the cube that merged cells give."""
    ref = 10**9
    df = spark.createDataFrame(_files(random.Random(5)), STATS)
    told = lambda x: sorted(tuple(map(str, r)) for r in x.select(*sorted(x.columns)).collect())
    cube = rollup.dguta(df, ref).cache()
    for kw in ({}, {"mask": tree.FILES, "age": 3}, {"gids": [1], "uids": [0, 2], "mask": 32, "age": 11}):
        assert told(rollup.summarise(df, ref, **kw)) == told(rollup.dir_summary(rollup.guta_filter(cube, **kw)))
    sets = df.withColumn("mount_path", F.regexp_extract("path", "^(/[^/]*)", 1))
    own = rollup.levels(sets, ref, ("mount_path",)).cache()
    assert told(rollup.merge_cubes(own)) == told(rollup.merge_cubes(rollup.aged(own, ("mount_path",))))
    assert told(rollup.dir_summary(rollup.at_age(own))) == told(rollup.dir_summary(rollup.guta_filter(rollup.aged(own, ("mount_path",)))))


def test_links_are_apart_only_below_their_common_directory(spark):
    """One row stands for all directories above; each directory had one before."""
    rows = [(f"/a/b/c/{x}", 5, 1, 1, 10, 10, 0, "f", 7, 3, 0, 5) for x in ("d/x.bam", "d/y.bam", "e/f/z.txt")]
    own = rollup._links(rollup.enriched(spark.createDataFrame(rows, STATS), 10**9)).collect()
    assert sorted((r.dir, r.up) for r in own) == [("/a/b/c/", True), ("/a/b/c/d/", False), ("/a/b/c/e/", False), ("/a/b/c/e/f/", False)]


def test_leaf_rows_meet_base_directories_before_ages(spark, tmp_path):
    """Rows aren't dealt out by directory and age, 17 for each directory at most."""
    df = spark.createDataFrame(_files(random.Random(6)), STATS)
    basedirs.unit_files(df, spark.createDataFrame([("/", 1)], "prefix string, mindirs int"), 10**9).write.parquet(str(tmp_path / "leaf"))
    leaf = spark.read.parquet(str(tmp_path / "leaf"))
    basedirs.basedirs(leaf, "uid").write.parquet(str(tmp_path / "bases"))
    plan = basedirs.subdirs(leaf, spark.read.parquet(str(tmp_path / "bases")), "uid")._jdf.queryExecution().executedPlan().toString()
    keys = [x.split("hashpartitioning(")[1] for x in plan.splitlines() if "hashpartitioning(" in x]
    assert keys and not [k for k in keys if " dir#" in k or k.startswith("dir#")]
