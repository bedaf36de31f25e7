"""Queries over base directories, usage, quotas, history, duplicates and globs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from dirlens.functions import ages, filetypes, formats, paths
from dirlens.operators import basedirs, filters, globs, usage
from dirlens.sources import files

from . import sql as S
from . import views
from .sql import REF, anc, age_ok, with_blocks
from .tree_queries import kept

C = F.col

S.CTE |= {
    "rules": "SELECT '/asia/' AS prefix, 3 AS mindirs FROM region WHERE r_name = 'ASIA' UNION ALL SELECT '/africa/nation_1', 4 FROM region WHERE r_name = 'AFRICA' UNION ALL SELECT '/', 2",
    "once": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir, CASE WHEN nlink > 1 AND inode <> 0 THEN concat('i', inode) ELSE path END ORDER BY path, size, gid, uid, atime, mtime) AS nth FROM typed WHERE entry_type <> 'd') WHERE nth = 1",
    "units": f"SELECT unit FROM (SELECT DISTINCT unnest({anc('dir')}) AS unit FROM once) WHERE len(string_split(unit, '/')) - 2 + CAST(unit = '/' AS INTEGER) = CASE WHEN starts_with(unit, '/asia/') THEN 3 WHEN starts_with(unit, '/africa/nation_1') THEN 4 ELSE 2 END",
    "unit_files": f"SELECT o.*, u.unit, CAST(a AS INTEGER) AS age FROM once o JOIN units u ON starts_with(o.dir, u.unit), range(17) r(a) WHERE {age_ok('a', 'atime', 'mtime')}",
    "owned": "SELECT 'gid' AS kind, gid AS id, uid AS other, * FROM unit_files UNION ALL SELECT 'uid', uid, gid, * FROM unit_files",
    "totals": "SELECT kind, id, age, unit, count(*) AS count, CAST(sum(size) AS BIGINT) AS size, min(atime) AS atime, max(mtime) AS mtime, bit_or(ft) AS ft, list_sort(list(DISTINCT other)) AS others FROM owned GROUP BY ALL",
    "held": f"SELECT kind, id, age, unit, up, count(*) AS n FROM (SELECT kind, id, age, unit, unnest({anc('dir')}) AS up FROM owned) GROUP BY ALL",
    "bases": "SELECT t.*, h.basedir FROM totals t JOIN (SELECT h.kind, h.id, h.age, h.unit, arg_max(up, length(up)) AS basedir FROM held h JOIN totals t USING (kind, id, age, unit) WHERE h.n = t.count GROUP BY ALL) h USING (kind, id, age, unit)",
    "subs": "SELECT o.kind, o.id, o.age, b.basedir, CASE WHEN o.dir = b.basedir THEN '.' ELSE regexp_extract(substr(o.dir, length(b.basedir) + 1), '^([^/]+)', 1) END AS sub, o.size, o.mtime, o.ft, b.mtime AS base_mtime FROM owned o JOIN bases b USING (kind, id, age, unit)",
    "group_usage": "SELECT b.id AS gid, b.basedir, b.age, array_to_string(others, ',') AS uids, b.size AS usage_size, coalesce(q.size_quota, 0) AS quota_size, b.count AS usage_inodes, coalesce(q.inode_quota, 0) AS quota_inodes, b.mtime FROM bases b LEFT JOIN quotas q ON q.gid = b.id AND starts_with(b.basedir, q.disk) WHERE kind = 'gid'",
}


def rules(s, d):
    r = views.table(s, d, "region")
    return r.where("r_name IN ('ASIA', 'AFRICA')").select(F.when(C("r_name") == "ASIA", "/asia/").otherwise("/africa/nation_1").alias("prefix"), F.when(C("r_name") == "ASIA", 3).otherwise(4).alias("mindirs")).union(r.limit(1).select(F.lit("/"), F.lit(2)))


def _leaf(s, d):
    """A table of its own, which base directories and what lies below them both read."""
    return kept(s, basedirs.unit_files(views.stats(s, d), rules(s, d), REF, partial(kept, s)))


def _bases(s, d, kind):
    return basedirs.basedirs(_leaf(s, d), kind)


def _told(df):
    return df.withColumn("others", F.array_join(C("others").cast("array<string>"), ",")).withColumn("ft", C("ft").cast("long"))


def _types(s, d, kind):
    leaf = _leaf(s, d)
    return basedirs.usage_by_type(leaf, basedirs.basedirs(leaf, kind), kind)


def _subs(s, d, kind):
    leaf = _leaf(s, d)
    return basedirs.subdirs(leaf, basedirs.basedirs(leaf, kind), kind)


def group_usage(s, d):
    u = _bases(s, d, "gid").withColumnRenamed("id", "gid")
    u = usage.quota_for_dir(u, views.quotas(s, d))
    return u.select("gid", "basedir", "age", F.array_join(C("others").cast("array<string>"), ",").alias("uids"), C("size").alias("usage_size"), "quota_size", C("count").alias("usage_inodes"), "quota_inodes", "mtime")


def user_usage(s, d):
    return _told(_bases(s, d, "uid")).select(C("id").alias("uid"), "basedir", "age", C("others").alias("gids"), C("size").alias("usage_size"), C("count").alias("usage_inodes"), "mtime")


def _usage0(s, d):
    return group_usage(s, d).where("age = 0")


def _status(s, d):
    f = usage.usage_forecast(group_usage(s, d), views.history(s, d), REF)
    return f.select("gid", "basedir", F.round(formats.percent_of(C("usage_size"), C("quota_size")) * 100).cast("long").alias("percent100"), formats.quota_status(C("date_no_space"), C("date_no_files"), REF).alias("status"))


def _globrules(s, d):
    """Patterns over the tree, one of each kind, from the regions that there are."""
    r, rule = F.lower("r_name"), lambda g, n: F.struct(g.alias("glob"), n.alias("group_name"))
    base = views.table(s, d, "region").where("r_name IN ('AFRICA', 'ASIA')")
    own = [rule(F.concat(F.lit("/"), r, F.lit(g)), F.concat(r, F.lit(n))) for g, n in (("/**", "_all"), ("/*/building/**", "_building"), ("/nation_*/household/**.txt", "_texts"))]
    general = [rule(F.lit(g), F.lit(n)) for g, n in (("/**.bam", "bams"), ("/**/tmp/**", "tmps"))]
    return base.select(F.explode(F.array(*own)).alias("x")).select("x.*").union(base.limit(1).select(F.explode(F.array(*general)).alias("x")).select("x.*"))


_GLOB_SQL = """
SELECT path, CASE
  WHEN regexp_matches(path, '^/(africa|asia)/nation_[^/]*/household/.*[.]txt$') THEN concat(split_part(path, '/', 2), '_texts')
  WHEN regexp_matches(path, '^/(africa|asia)/[^/]*/building/') THEN concat(split_part(path, '/', 2), '_building')
  WHEN regexp_matches(path, '^/(africa|asia)/') THEN concat(split_part(path, '/', 2), '_all')
  WHEN regexp_matches(path, '^/.*/tmp/') THEN 'tmps'
  WHEN regexp_matches(path, '^/.*[.]bam$') THEN 'bams' END AS glob_group
FROM stats"""


def _nation_rules(s, d):
    """A rule for each nation wherever it is, for each of its segments, and for each kind of file and nation."""
    n = F.lower("n_name")
    rule = lambda g, name: F.struct(g.alias("glob"), name.alias("group_name"))
    segments = views.table(s, d, "customer").select(F.lower("c_mktsegment").alias("segment")).distinct()
    nations = views.table(s, d, "nation")
    far = nations.select(rule(F.concat(F.lit("/**/"), n, F.lit("/**")), n).alias("x"))
    near = nations.join(F.broadcast(segments)).select(rule(F.concat(F.lit("/*/"), n, F.lit("/"), "segment", F.lit("/**.txt")), F.concat(n, F.lit("_"), "segment")).alias("x"))
    temp = nations.select(rule(F.concat(F.lit("/*/"), n, F.lit("/*/c*/**/tmp/**")), F.concat(n, F.lit("_tmp"))).alias("x"))
    return far.union(near).union(temp).select("x.*")


_NATION_SQL = """
SELECT path, CASE WHEN path LIKE '%.txt' THEN concat(split_part(path, '/', 3), '_', split_part(path, '/', 4))
  WHEN path LIKE '%/tmp/%' THEN concat(split_part(path, '/', 3), '_tmp') ELSE split_part(path, '/', 3) END AS glob_group
FROM stats"""

_BASES_SQL = "SELECT id, age, unit, basedir, count, size, atime, mtime, ft, array_to_string(others, ',') AS others FROM bases WHERE kind = '{}'"
_SUBS_SQL = "SELECT id, age, basedir, sub, count(*) AS count, CAST(sum(size) AS BIGINT) AS size, max(CASE WHEN sub = '.' THEN base_mtime ELSE mtime END) AS mtime FROM subs WHERE kind = '{}' {} GROUP BY 1, 2, 3, 4"
_POINTS = "date, usage_size, quota_size, usage_inodes, quota_inodes"
_LINE = "SELECT *, first_value(date) OVER w AS first_date, coalesce(lag(date, 2) OVER w, first_value(date) OVER w) AS d0, coalesce(lag(usage_size, 2) OVER w, first_value(usage_size) OVER w) AS s0, coalesce(lag(usage_inodes, 2) OVER w, first_value(usage_inodes) OVER w) AS i0, row_number() OVER (PARTITION BY gid, mount_path ORDER BY date DESC) AS back FROM history WINDOW w AS (PARTITION BY gid, mount_path ORDER BY date)"


def _full(used, quota, old):
    return f"CASE WHEN {used} >= {quota} THEN date WHEN {used} > {old} AND date > d0 AND CAST(floor(date + ({quota} - {used})::DOUBLE * (date - d0)::DOUBLE / ({used} - {old})::DOUBLE) AS BIGINT) <= {REF + 5 * 365 * 86400} THEN CAST(floor(date + ({quota} - {used})::DOUBLE * (date - d0)::DOUBLE / ({used} - {old})::DOUBLE) AS BIGINT) END"


S.CTE |= {
    "line": _LINE,
    "forecast": f"SELECT gid, mount_path, date, {_full('usage_size', 'quota_size', 's0')} AS date_no_space, {_full('usage_inodes', 'quota_inodes', 'i0')} AS date_no_files FROM line WHERE back = 1",
}
S.CTE["group_usage"] = S.CTE.pop("group_usage")


_PROJECTION_SQL = """
WITH l AS (SELECT gid, mount_path, date, usage_size::DOUBLE AS used, quota_size::DOUBLE AS quota, CASE WHEN date > d0 THEN (usage_size::DOUBLE - s0::DOUBLE) / (date - d0) ELSE 0.0 END AS slope,
                  date + (date - first_date) / 5 AS until FROM line WHERE back = 1),
v AS (SELECT *, used + slope * (until - date) AS value FROM l WHERE used < quota)
SELECT gid, mount_path, CAST(floor(CASE WHEN value > quota THEN date + (quota - used) / slope WHEN value < 0 THEN date - used / slope ELSE until END) AS BIGINT) AS date,
       CAST(floor(least(quota, greatest(0.0, value))) AS BIGINT) AS value FROM v"""


def _page(s, d):
    from pyspark.sql import Window

    u = usage.with_owner(_usage0(s, d), views.owners(s, d)).where(C("owner") != "")
    page = u.orderBy(F.desc("usage_size"), "basedir", "gid").offset(5).limit(10)
    return page.withColumn("place", F.row_number().over(Window.orderBy(F.desc("usage_size"), "basedir", "gid")).cast("long")).select("place", "gid", "basedir", "usage_size", "owner")


def _listed(df, column):
    return df.withColumn(column, F.split(column, ",").cast("array<long>"))


def _members(s, d):
    """Each user is in the groups of its customers' nations."""
    return views.table(s, d, "customer").select(F.concat(F.lit("u"), C("c_custkey") % 97).alias("user"), C("c_nationkey").cast("long").alias("gid")).distinct()


def _rights(s, d):
    return filters.rights(_members(s, d).where("gid % 4 > 0 OR user < 'u3'"), views.owners(s, d).where("gid IN (4, 8)").select("gid"))


def _requests(bases, odd):
    """Every base directory of an age, asked for by two users."""
    return bases.where("age = 3").select(F.explode(F.array(F.concat(F.lit("u"), C("id") % 97), F.concat(F.lit("u"), (C("id") * 7 + odd) % 97))).alias("user"), "id", "basedir", "age").distinct()


def _group_subdirs_for(s, d):
    leaf = _leaf(s, d)
    bases = kept(s, basedirs.basedirs(leaf, "gid"))
    return filters.allowed_subdirs(_requests(bases, 1), basedirs.subdirs(leaf, bases, "gid"), _rights(s, d)).select("user", "id", "basedir", "sub", "count", "size")


def _user_subdirs_for(s, d):
    leaf = _leaf(s, d)
    bases = kept(s, basedirs.basedirs(leaf, "uid"))
    dirs = leaf.select("gid", "dir").distinct()
    own = dirs.select("gid", F.explode(paths.ancestors(C("dir"))).alias("dir")).distinct()
    return filters.allowed_subdirs(_requests(bases, 2), basedirs.subdirs(leaf, bases, "uid"), _rights(s, d), own.groupBy("dir").agg(F.collect_set("gid").alias("gids"))).select("user", "id", "basedir", "sub", "count", "size")


def _sorted_pages(s, d):
    """Second pages by several columns in both directions, and the last one in place of one that isn't there."""
    path, out = files.scratch(s), None
    usage.with_owner(_usage0(s, d), views.owners(s, d)).write.parquet(path)
    rows = s.read.parquet(path)
    for by, reverse, number in (("usage_inodes", False, 1), ("percent_size", False, 1), ("percent_size", True, 1), ("owner", True, 1), ("mtime", True, 999)):
        page = usage.usage_page(rows, usage.usage_order(by, reverse), 10, number).select(F.lit(f"{by} {reverse}").alias("sort"), "place", "gid", "basedir")
        out = page if out is None else out.union(page)
    return out


def _sorted_sql():
    each = []
    for by, reverse, number in (("usage_inodes", False, 1), ("percent_size", False, 1), ("percent_size", True, 1), ("owner", True, 1), ("mtime", True, 999)):
        value = "usage_size / nullif(quota_size, 0)" if by == "percent_size" else by
        order = f"{value} {'DESC NULLS LAST' if reverse else 'NULLS FIRST'}, basedir, gid"
        each.append(f"SELECT '{by} {reverse}' AS sort, place, gid, basedir FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place, least({number}, (count(*) OVER () - 1) // 10) AS page FROM owned_usage) WHERE place > 10 * page AND place <= 10 * page + 10")
    return " UNION ALL ".join(each)


S.CTE |= {
    "owned_usage": "SELECT u.*, coalesce(owner, '') AS owner FROM group_usage u LEFT JOIN owners USING (gid) WHERE age = 0",
    "members": "SELECT DISTINCT concat('u', c_custkey % 97) AS \"user\", CAST(c_nationkey AS BIGINT) AS gid FROM customer WHERE c_nationkey % 4 > 0 OR concat('u', c_custkey % 97) < 'u3'",
    "sees_all": "SELECT \"user\" FROM members WHERE gid IN (SELECT gid FROM owners WHERE gid IN (4, 8))",
    "asked": "SELECT DISTINCT kind, unnest([concat('u', id % 97), concat('u', (id * 7 + CASE WHEN kind = 'gid' THEN 1 ELSE 2 END) % 97)]) AS \"user\", id, basedir, age FROM bases WHERE age = 3",
    "dir_gids": f"SELECT DISTINCT gid, unnest({anc('dir')}) AS dir FROM files",
    "sub_sums": "SELECT kind, id, age, basedir, sub, count(*) AS count, CAST(sum(size) AS BIGINT) AS size FROM subs GROUP BY ALL",
}
_SUBS_FOR = "SELECT a.\"user\", a.id, a.basedir, s.sub, s.count, s.size FROM asked a JOIN sub_sums s USING (kind, id, basedir, age) WHERE kind = '{0}' AND a.\"user\" IN (SELECT \"user\" FROM members) AND (a.\"user\" IN (SELECT \"user\" FROM sees_all) OR EXISTS (SELECT 1 FROM members m WHERE m.\"user\" = a.\"user\" AND {1}))"
_DAYS = f"greatest(0, floor(({REF} - mtime) / 86400))"

QUERIES = {
    "usage_filter_groups": (lambda s, d: _listed(usage.with_owner(group_usage(s, d), views.owners(s, d)), "uids").where(filters.usage_filter("group", REF, uids=(3, 7, 20, 31), owners=("PI_NATION_2", "PI_NATION_8", "PI_NATION_12", "PI_NATION_18"), size=filters.Range(1000, 10**10), days=filters.Range(None, 2500), age=2)).select("gid", "basedir", "owner", "usage_size", "mtime"), with_blocks(f"SELECT gid, basedir, owner, usage_size, mtime FROM group_usage JOIN owners USING (gid) WHERE list_has_any(string_split(uids, ','), ['3', '7', '20', '31']) AND owner IN ('PI_NATION_2', 'PI_NATION_8', 'PI_NATION_12', 'PI_NATION_18') AND usage_size BETWEEN 1000 AND 10000000000 AND {_DAYS} <= 2500 AND age = 2")),
    "usage_filter_users": (lambda s, d: _listed(user_usage(s, d), "gids").where(filters.usage_filter("user", REF, uids=tuple(range(0, 97, 2)), gids=(1, 2, 8, 9), days=filters.Range(170, 400), age=1, text="nation")).select("uid", "basedir", "usage_size", "usage_inodes"), with_blocks(f"SELECT id AS uid, basedir, size AS usage_size, count AS usage_inodes FROM bases WHERE kind = 'uid' AND id % 2 = 0 AND list_has_any(others, [1, 2, 8, 9]) AND {_DAYS} BETWEEN 170 AND 400 AND age = 1 AND contains(basedir, 'nation')")),
    "usage_sorted": (_sorted_pages, with_blocks(_sorted_sql())),
    "group_subdirs_for": (_group_subdirs_for, with_blocks(_SUBS_FOR.format("gid", "m.gid = a.id"))),
    "user_subdirs_for": (_user_subdirs_for, with_blocks(_SUBS_FOR.format("uid", "m.gid IN (SELECT gid FROM dir_gids g WHERE g.dir = a.basedir)"))),
    "rights": (lambda s, d: _rights(s, d).withColumn("allowed", F.array_join(C("allowed").cast("array<string>"), ",")), with_blocks("SELECT \"user\", string_agg(gid, ',' ORDER BY gid) AS allowed, \"user\" IN (SELECT \"user\" FROM sees_all) AS \"all\" FROM members GROUP BY 1")),
    "history_counts": (lambda s, d: usage.history_counts(views.history(s, d)), with_blocks("SELECT (SELECT count(*) FROM (SELECT DISTINCT gid, mount_path FROM history)) AS histories, count(*) AS points FROM history")),
    "user_names": (lambda s, d: usage.names_in_use(usage.with_names(user_usage(s, d), _members(s, d).select(F.substring("user", 2, 9).cast("long").alias("id"), C("user").alias("name")).distinct(), "uid", "name", ""), "name"), with_blocks("SELECT DISTINCT concat('u', id) AS name FROM bases WHERE kind = 'uid'")),
    "group_names": (lambda s, d: usage.names_in_use(usage.with_names(_usage0(s, d), views.table(s, d, "nation").select(C("n_nationkey").cast("long").alias("id"), C("n_name").alias("name")), "gid", "name", ""), "name"), with_blocks("SELECT DISTINCT n_name AS name FROM group_usage JOIN nation ON n_nationkey = gid WHERE age = 0")),
    "basedir_rule": (lambda s, d: basedirs.rule_for(views.stats(s, d).select(F.explode(paths.ancestors(paths.parent(C("path"), C("entry_type")))).alias("dir")).distinct(), rules(s, d)), with_blocks(f"SELECT dir, CAST(CASE WHEN starts_with(dir, '/asia/') THEN 3 WHEN starts_with(dir, '/africa/nation_1') THEN 4 ELSE 2 END AS INTEGER) AS mindirs FROM (SELECT DISTINCT unnest({anc('dir')}) AS dir FROM files)")),
    "basedirs_group": (lambda s, d: _told(_bases(s, d, "gid")), with_blocks(_BASES_SQL.format("gid"))),
    "basedirs_user": (lambda s, d: _told(_bases(s, d, "uid")), with_blocks(_BASES_SQL.format("uid"))),
    "subdirs_group": (lambda s, d: _subs(s, d, "gid"), with_blocks(_SUBS_SQL.format("gid", ""))),
    "subdirs_user": (lambda s, d: _subs(s, d, "uid"), with_blocks(_SUBS_SQL.format("uid", ""))),
    "group_subdirs": (lambda s, d: _subs(s, d, "gid").where("age = 0 AND id IN (1, 2, 8)"), with_blocks(_SUBS_SQL.format("gid", "AND age = 0 AND id IN (1, 2, 8)"))),
    "user_subdirs": (lambda s, d: _subs(s, d, "uid").where("age = 0 AND id = 17"), with_blocks(_SUBS_SQL.format("uid", "AND age = 0 AND id = 17"))),
    "usage_by_type": (lambda s, d: _types(s, d, "gid").where("age = 0").withColumn("type", C("type").cast("long")), with_blocks("SELECT id, age, basedir, sub, CAST(type AS BIGINT) AS type, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT *, unnest(CASE WHEN ft & 1 > 0 THEN [ft & ~1, 1] ELSE [ft] END) AS type FROM subs WHERE kind = 'gid' AND age = 0) GROUP BY 1, 2, 3, 4, 5")),
    "basedirs_absorb": (lambda s, d: basedirs.absorb(_bases(s, d, "uid")), with_blocks("SELECT id, age, basedir, CAST(sum(count) AS BIGINT) AS count, CAST(sum(size) AS BIGINT) AS size, min(atime) AS atime, max(mtime) AS mtime FROM (SELECT b.id, b.age, b.count, b.size, b.atime, b.mtime, (SELECT arg_min(u.basedir, length(u.basedir)) FROM bases u WHERE u.kind = b.kind AND u.id = b.id AND u.age = b.age AND starts_with(b.basedir, u.basedir)) AS basedir FROM bases b WHERE kind = 'uid') GROUP BY 1, 2, 3")),
    "group_usage": (group_usage, with_blocks("SELECT * FROM group_usage")),
    "user_usage": (user_usage, with_blocks("SELECT id AS uid, basedir, age, array_to_string(others, ',') AS gids, size AS usage_size, count AS usage_inodes, mtime FROM bases WHERE kind = 'uid'")),
    "usage_all_ages": (lambda s, d: group_usage(s, d).groupBy("age").agg(F.count("*").alias("n"), F.sum("usage_size").alias("size"), F.sum("usage_inodes").alias("inodes")), with_blocks("SELECT age, count(*) AS n, CAST(sum(usage_size) AS BIGINT) AS size, CAST(sum(usage_inodes) AS BIGINT) AS inodes FROM group_usage GROUP BY 1")),
    "usage_with_owner": (lambda s, d: usage.with_owner(_usage0(s, d), views.owners(s, d)), with_blocks("SELECT u.*, coalesce(owner, '') AS owner FROM group_usage u LEFT JOIN owners USING (gid) WHERE age = 0")),
    "id_names": (lambda s, d: usage.with_names(views.stats(s, d).groupBy("uid", "gid").agg(F.count("*").alias("n")), views.stats(s, d).select(C("uid").alias("id"), F.concat(F.lit("u"), "uid").alias("name")).where("uid < 90").distinct(), "uid", "user"), with_blocks("SELECT uid, gid, count(*) AS n, concat(CASE WHEN uid < 90 THEN 'u' ELSE 'id' END, uid) AS user FROM stats GROUP BY 1, 2")),
    "quota_for_dir": (lambda s, d: usage.quota_for_dir(views.stats(s, d).select("gid", paths.parent(C("path"), C("entry_type")).alias("basedir")).distinct(), views.quotas(s, d)), with_blocks("SELECT f.gid, f.dir AS basedir, coalesce(size_quota, 0) AS quota_size, coalesce(inode_quota, 0) AS quota_inodes FROM (SELECT DISTINCT gid, dir FROM files) f LEFT JOIN quotas q ON q.gid = f.gid AND starts_with(f.dir, disk)")),
    "mount_of_path": (lambda s, d: usage.mount_of_path(views.stats(s, d).select("path"), views.mounts(s, d), "path"), with_blocks("SELECT path, (SELECT arg_max(mount, length(mount)) FROM mounts WHERE starts_with(path, mount)) AS mount FROM stats")),
    "group_mount_totals": (lambda s, d: usage.mount_of_path(_usage0(s, d), views.mounts(s, d), "basedir").where("mount <> ''").groupBy("gid", "mount").agg(F.sum("usage_inodes").alias("count"), F.sum("usage_size").alias("size")), with_blocks("SELECT gid, (SELECT arg_max(mount, length(mount)) FROM mounts WHERE starts_with(basedir, mount)) AS mount, CAST(sum(usage_inodes) AS BIGINT) AS count, CAST(sum(usage_size) AS BIGINT) AS size FROM group_usage WHERE age = 0 GROUP BY 1, 2")),
    "basedirs_info": (lambda s, d: _subs(s, d, "gid").where("age = 0").agg(F.count_distinct("id", "basedir").alias("combos"), F.count("*").alias("subdirs")), with_blocks("SELECT (SELECT count(*) FROM (SELECT DISTINCT id, basedir FROM bases WHERE kind = 'gid' AND age = 0)) AS combos, (SELECT count(*) FROM (SELECT DISTINCT id, basedir, sub FROM subs WHERE kind = 'gid' AND age = 0)) AS subdirs")),
    "usage_totals": (lambda s, d: _page(s, d).agg(F.sum("usage_size").alias("size"), F.count("*").alias("n")), with_blocks("SELECT CAST(sum(usage_size) AS BIGINT) AS size, count(*) AS n FROM (SELECT usage_size FROM group_usage JOIN owners USING (gid) WHERE age = 0 ORDER BY usage_size DESC, basedir, gid LIMIT 10 OFFSET 5)")),
    "usage_page": (_page, with_blocks("SELECT row_number() OVER (ORDER BY usage_size DESC, basedir, gid) AS place, gid, basedir, usage_size, owner FROM (SELECT * FROM group_usage JOIN owners USING (gid) WHERE age = 0 ORDER BY usage_size DESC, basedir, gid LIMIT 10 OFFSET 5)")),
    "usage_filter": (lambda s, d: group_usage(s, d).where((C("age") == 0) & C("gid").isin([1, 2, 3, 8]) & C("usage_size").between(1000, 10**9) & F.contains("basedir", F.lit("nation"))), with_blocks("SELECT * FROM group_usage WHERE age = 0 AND gid IN (1, 2, 3, 8) AND usage_size BETWEEN 1000 AND 1000000000 AND contains(basedir, 'nation')")),
    "largest_usage": (lambda s, d: _usage0(s, d).agg(F.max_by(F.struct("gid", "basedir"), F.struct("usage_size", "basedir")).alias("x"), F.max("usage_size").alias("size")).select("x.gid", "x.basedir", "size"), with_blocks("SELECT gid, basedir, usage_size AS size FROM group_usage WHERE age = 0 ORDER BY usage_size DESC, basedir DESC LIMIT 1")),
    "usage_status": (_status, with_blocks(f"SELECT u.gid, u.basedir, CAST(round(10000 * usage_size / nullif(quota_size, 0)) / 100 * 100 AS BIGINT) AS percent100, CASE WHEN coalesce(date_no_space <= {REF + 3 * 86400}, false) OR coalesce(date_no_files <= {REF + 3 * 86400}, false) THEN 'Not OK' ELSE 'OK' END AS status FROM group_usage u LEFT JOIN forecast f ON f.gid = u.gid AND starts_with(u.basedir, f.mount_path) WHERE age = 0")),
    "usage_forecast": (lambda s, d: usage.usage_forecast(group_usage(s, d), views.history(s, d), REF).select("gid", "basedir", "date_no_space", "date_no_files"), with_blocks("SELECT u.gid, u.basedir, date_no_space, date_no_files FROM group_usage u LEFT JOIN forecast f ON f.gid = u.gid AND starts_with(u.basedir, f.mount_path) WHERE age = 0")),
    "scatter_domain": (lambda s, d: _usage0(s, d).agg(*[F.expr(e).cast("long").alias(n) for n, e in (("size_low", "floor(pow(2, floor(log2(min(usage_size) / 100D)))) * 100"), ("size_high", "ceil(pow(2, ceil(log2(max(usage_size) / 100D)))) * 100"), ("days_high", f"pow(10, ceil(log10(floor(({REF} - min(mtime)) / 86400))))"))]), with_blocks(f"SELECT CAST(floor(2 ** floor(log2(min(usage_size) / 100.0))) * 100 AS BIGINT) AS size_low, CAST(ceil(2 ** ceil(log2(max(usage_size) / 100.0))) * 100 AS BIGINT) AS size_high, CAST(10 ** ceil(log10(floor(({REF} - min(mtime)) / 86400))) AS BIGINT) AS days_high FROM group_usage WHERE age = 0")),
    "owner_list": (lambda s, d: usage.with_owner(_usage0(s, d), views.owners(s, d)).where("owner <> ''").select("owner").distinct(), with_blocks("SELECT DISTINCT owner FROM group_usage JOIN owners USING (gid) WHERE age = 0")),
    "quota_forecast": (lambda s, d: usage.quota_forecast(views.history(s, d), REF), with_blocks("SELECT * FROM forecast")),
    "quota_days_left": (lambda s, d: usage.quota_forecast(views.history(s, d), REF).select("gid", "mount_path", usage.days_left(C("date_no_space"), REF).alias("days"), F.least(F.lit(25), usage.days_left(C("date_no_space"), REF)).alias("shown")), with_blocks(f"SELECT gid, mount_path, CAST(round(date_no_space / 86400.0) AS BIGINT) - {REF // 86400} AS days, least(25, CAST(round(date_no_space / 86400.0) AS BIGINT) - {REF // 86400}) + CASE WHEN date_no_space IS NULL THEN NULL ELSE 0 END AS shown FROM forecast")),
    "usage_projection": (lambda s, d: usage.usage_projection(views.history(s, d)), with_blocks(_PROJECTION_SQL)),
    "history": (lambda s, d: usage.history_of(views.history(s, d), 7, "/asia/nation_7/building/"), with_blocks(f"SELECT gid, mount_path, {_POINTS} FROM history WHERE gid = 7 AND starts_with('/asia/nation_7/building/', mount_path)")),
    "history_append": (lambda s, d: usage.history_append(views.history(s, d).where("date < 915000000"), views.history(s, d).where("gid % 2 = 0")), with_blocks("SELECT * FROM history WHERE date < 915000000 OR gid % 2 = 0")),
    "history_seed": (lambda s, d: usage.history_seed(views.history(s, d).where("date > 900000000"), views.history(s, d).where("date < 940000000")), with_blocks("SELECT * FROM history")),
    "history_invalid": (lambda s, d: usage.history_invalid(views.history(s, d), "/a"), with_blocks("SELECT DISTINCT gid, mount_path FROM history WHERE NOT starts_with(mount_path, '/a')")),
    "history_clean": (lambda s, d: usage.history_clean(views.history(s, d), "/a"), with_blocks("SELECT * FROM history WHERE starts_with(mount_path, '/a')")),
    "dupes_by_size": (lambda s, d: basedirs.dupes_by_size(views.stats(s, d), 50_000, F.regexp_extract("path", "^(/[^/]+/)", 1)).withColumn("paths", F.array_join("paths", "|")), with_blocks("WITH sets AS (SELECT apparent_size, regexp_extract(path, '^(/[^/]+/)', 1) AS mount, CASE WHEN inode <> 0 THEN concat('i', inode) ELSE path END AS link_set, string_agg(path, '|' ORDER BY path) AS paths FROM stats WHERE size >= 50000 GROUP BY 1, 2, 3) SELECT s.*, n_sets FROM sets s JOIN (SELECT apparent_size, count(*) AS n_sets FROM sets GROUP BY 1 HAVING count(*) >= 2) USING (apparent_size)")),
    "glob_group": (lambda s, d: globs.glob_group(views.stats(s, d).select("path"), _globrules(s, d)), with_blocks(_GLOB_SQL)),
    "glob_group_nations": (lambda s, d: globs.glob_group(views.stats(s, d).select("path"), _nation_rules(s, d)), with_blocks(_NATION_SQL)),
    "latency_percentiles": (lambda s, d: basedirs.nearest_rank(views.table(s, d, "events").select("event_type", F.floor(C("value") * 1000).cast("long").alias("ms")), ["event_type"], "ms"), "SELECT event_type, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, count(*) AS n FROM (SELECT event_type, CAST(floor(value * 1000) AS BIGINT) AS ms FROM events) GROUP BY 1"),
}
