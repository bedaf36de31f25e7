"""SQL twins: named building blocks for DuckDB, put before a query that mentions them."""

from __future__ import annotations

import re

from dirlens.functions import ages, filetypes

from . import views

REF = views.REF_TIME


def anc(d: str) -> str:
    """All ancestors of a directory, as a list."""
    p = f"list_filter(string_split({d}, '/'), lambda x: x <> '')"
    return f"list_transform(range(0, len({p}) + 1), lambda i: CASE WHEN i = 0 THEN '/' ELSE concat('/', array_to_string(({p})[1:i], '/'), '/') END)"


def up(d: str) -> str:
    return f"CASE WHEN {d} <> '/' THEN regexp_replace({d}, '[^/]+/$', '') END"


def ft(name: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({name}), '{p}') THEN {bit}" for bit, p in filetypes.PATTERNS) + f" ELSE {filetypes.OTHER} END"


def temp(name: str) -> str:
    return f"regexp_matches(lower({name}), '{filetypes.TEMP_PATTERN}')"


def temp_dir(d: str) -> str:
    return f"len(list_filter(regexp_extract_all(lower({d}), '([^/]+/)', 1), lambda p: regexp_matches(p, '{filetypes.TEMP_PATTERN}'))) > 0"


def bucket(t: str) -> str:
    return f"CASE WHEN {t} > 0 THEN CASE " + " ".join(f"WHEN {REF} - {t} >= {d * ages.DAY} THEN {i}" for i, d in enumerate(ages.BUCKET_DAYS)) + " ELSE 8 END END"


def age_ok(a: str, atime: str, mtime: str) -> str:
    limits = "[" + ", ".join(str(REF - m * ages.MONTH) for m in ages.CODE_MONTHS) + "]"
    return f"({a} = 0 OR ({a} <= 8 AND {atime} <= {limits}[{a}]) OR ({a} > 8 AND {mtime} <= {limits}[{a} - 8]))"


def mask_names(m: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {m} & {bit} > 0 THEN '{n}' END" for bit, n in filetypes.NAMES.items()) + ")"


FILES = filetypes.ALL & ~filetypes.TEMP & ~filetypes.DIR
_HIST = ", ".join(f"CAST(count(*) FILTER ({k}_bucket = {i}) AS BIGINT) AS {k}{i}" for k in "am" for i in range(9))
_HISTS = ", ".join(f"CAST(sum({k}{i}) AS BIGINT) AS {k}{i}" for k in "am" for i in range(9))

CTE = {
    "stats": views.STATS_SQL,
    "quotas": views.QUOTAS_SQL,
    "owners": views.OWNERS_SQL,
    "areas": views.AREAS_SQL,
    "mounts": views.MOUNTS_SQL,
    "history": views.HISTORY_SQL,
    "datasets": views.DATASETS_SQL,
    "below": f"SELECT unnest({anc('''regexp_replace(path, '[^/]+/?$', '')''')}) AS dir, path, uid, gid, atime, mtime, ctime, nlink FROM stats",
    "infill": "SELECT dir AS path, 0 AS size, arg_min(uid, path) AS uid, arg_min(gid, path) AS gid, arg_min(atime, path) AS atime, arg_min(mtime, path) AS mtime, arg_min(ctime, path) AS ctime, 'd' AS entry_type, 0 AS inode, arg_min(nlink, path) AS nlink FROM below GROUP BY dir",
    "entries": "SELECT path, size, uid, gid, atime, mtime, ctime, entry_type, inode, nlink FROM stats UNION ALL SELECT * FROM infill",
    "named": "SELECT CASE WHEN entry_type = 'd' THEN path ELSE regexp_replace(path, '[^/]+$', '') END AS dir, regexp_extract(path, '([^/]*/?)$', 1) AS name, * FROM entries",
    "typed": f"SELECT dir, path, size, uid, gid, CASE WHEN entry_type = 'd' THEN {REF} ELSE atime END AS atime, mtime, inode, nlink, entry_type, CASE WHEN {temp('name')} OR {temp_dir('dir')} THEN ({ft('name')}) | 1 ELSE ({ft('name')}) END AS ft FROM named",
    "spread": f"SELECT unnest({anc('dir')}) AS d, * FROM typed",
    "links": "SELECT d, inode, arg_min(gid, path) AS gid, arg_min(uid, path) AS uid, bit_or(ft) AS ft, max(size) AS size, min(atime) AS atime, max(mtime) AS mtime FROM spread WHERE nlink > 1 AND inode <> 0 GROUP BY d, inode",
    "cells": "SELECT d, gid, uid, ft, size, atime, mtime FROM spread WHERE NOT (nlink > 1 AND inode <> 0) UNION ALL SELECT d, gid, uid, ft, size, atime, mtime FROM links",
    "marked": f"SELECT *, {bucket('atime')} AS a_bucket, {bucket('mtime')} AS m_bucket FROM cells",
    "aged": f"SELECT m.*, CAST(a AS INTEGER) AS age FROM marked m, range(17) AS r(a) WHERE {age_ok('a', 'atime', 'mtime')}",
    "cube": f"SELECT d AS dir, gid, uid, ft, age, count(*) AS count, CAST(sum(size) AS BIGINT) AS size, coalesce(min(atime) FILTER (atime > 0), 0) AS atime, coalesce(max(mtime) FILTER (mtime > 0), 0) AS mtime, {_HIST} FROM aged GROUP BY ALL",
    "summary": f"SELECT dir, CAST(sum(count) AS BIGINT) AS count, CAST(sum(size) AS BIGINT) AS size, coalesce(min(atime) FILTER (atime <> 0), 0) AS atime, max(mtime) AS mtime, bit_or(ft) AS ft, list_sort(list(DISTINCT uid)) AS uids, list_sort(list(DISTINCT gid)) AS gids, {_HISTS} FROM cube WHERE age = 0 AND ft & {FILES} > 0 GROUP BY dir HAVING sum(count) > 0",
    "kids": f"SELECT *, {up('dir')} AS parent_dir FROM summary",
    "files": "SELECT *, regexp_replace(path, '[^/]+$', '') AS dir FROM stats WHERE entry_type <> 'd'",
}


def _by_dataset() -> dict[str, str]:
    """The blocks from stats to cube for each mount_path by itself, under names that begin with ds_."""
    names = ["stats", "below", "infill", "entries", "named", "typed", "spread", "links", "cells", "marked", "aged", "cube"]
    out = {"ds_stats": "SELECT *, regexp_extract(path, '^(/[^/]+/)', 1) AS mount_path FROM stats"}
    for name in names[1:]:
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 ds_\2", CTE[name]).replace("GROUP BY d", "GROUP BY mount_path, d")
        if name not in ("named", "spread", "marked", "aged"):  # these select all columns
            text = re.sub(r"SELECT (?!\*)", "SELECT mount_path, ", text)
        out[f"ds_{name}"] = text
    return out


CTE |= _by_dataset()


def with_blocks(query: str) -> str:
    """The query after all blocks it needs."""
    needed: set[str] = set()

    def find(text: str) -> None:
        for name in CTE:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                find(CTE[name])

    find(query)
    query = query.strip()
    head = ", ".join(f"{n} AS ({CTE[n].strip()})" for n in CTE if n in needed)
    recursive = query.upper().startswith("WITH RECURSIVE")
    own = re.sub(r"^WITH (RECURSIVE )?", "", query, flags=re.IGNORECASE)
    if not head:
        return query
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}" + (f", {own}" if own != query else f" {query}")
