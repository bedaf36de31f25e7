"""Path columns. A directory is a string with a trailing slash; every function takes and gives Columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """Last component; a directory keeps its trailing slash."""
    return F.when(F.endswith(path, F.lit("/")), F.concat(F.substring_index(F.left(path, F.length(path) - 1), "/", -1), F.lit("/"))).otherwise(F.substring_index(path, "/", -1))


def parent(path: Column, entry_type: Column) -> Column:
    """The directory that holds a file; a directory belongs to itself."""
    return F.when(entry_type == "d", path).otherwise(F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1))))


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def depth(directory: Column) -> Column:
    """/ has 0, /a/ has 1."""
    return F.length(directory) - F.length(F.replace(directory, F.lit("/"), F.lit(""))) - 1


def split_keep(path: Column) -> Column:
    """["a/", "b/", "c"] of /a/b/c."""
    return F.regexp_extract_all(path, F.lit(r"([^/]+/?)"), F.lit(1))


def _tidy(directory: Column) -> Column:
    """Whether each slash but the first ends a component, so that components are found by counting slashes."""
    return F.startswith(directory, F.lit("/")) & F.endswith(directory, F.lit("/")) & ~F.contains(directory, F.lit("//"))


def _cut(directory: Column, components: int | Column) -> Column:
    """So many components of a tidy directory, which has as many at least."""
    return F.concat(F.call_function("substring_index", directory, F.lit("/"), F.lit(components) + 1), F.lit("/"))


def ancestors(directory: Column, from_depth: int | Column = 0) -> Column:
    """The directory and all above it, from the root (or a depth) down.

    What a lambda holds is worked out anew for each element, so a tidy directory is cut and not split."""
    p, start, deep = parts(directory), F.lit(from_depth), depth(directory)
    tidy = F.transform(F.sequence(start, F.greatest(deep, start)), lambda i: _cut(directory, F.least(i, deep)))
    other = F.transform(F.sequence(start, F.greatest(F.size(p), start)), lambda i: F.when(i == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(p, F.lit(1), i), "/"), F.lit("/"))))
    return F.when(_tidy(directory), tidy).otherwise(other)


def top(directory: Column, components: int) -> Column:
    """The directory's ancestor of so many components; one of fewer is its own."""
    other = F.concat(F.lit("/"), F.array_join(F.transform(F.slice(parts(directory), 1, components), lambda p: F.concat(p, F.lit("/"))), ""))
    return F.when(_tidy(directory), F.when(depth(directory) <= components, directory).otherwise(_cut(directory, components))).otherwise(other)


def common(low: Column, high: Column) -> Column:
    """The deepest directory that two directories lie in."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.least(depth(low), depth(high))), lambda i: _cut(low, i) == _cut(high, i))) - 1
    a, b = parts(low), parts(high)
    n = F.size(F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i))) - 1
    other = F.when(n == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(a, F.lit(1), n), "/"), F.lit("/")))
    return F.when(_tidy(low) & _tidy(high), _cut(low, same)).otherwise(other)


def parent_dir(directory: Column) -> Column:
    """The directory above; null for the root."""
    return F.when(directory != "/", F.regexp_replace(directory, r"[^/]+/$", ""))


def order_key(path: Column) -> Column:
    """Sorts by components, a prefix first."""
    return F.split(path, "/")


def normalise(path: Column) -> Column:
    """Trimmed, with one slash at each end."""
    inner = F.regexp_replace(F.trim(path), r"^/+|/+$", "")
    return F.when(inner == "", F.lit("/")).otherwise(F.concat(F.lit("/"), inner, F.lit("/")))


def mount_from_name(name: Column) -> Column:
    """The mount a dataset <version>_<key> holds; the key writes / as a full-width solidus."""
    key = F.translate(F.regexp_extract(name, r"^[^_]*_(.*)$", 1), "／", "/")
    return F.when(~F.contains(name, F.lit("_")), F.lit("/")).otherwise(F.when(F.endswith(key, F.lit("/")), key).otherwise(F.concat(key, F.lit("/"))))


def unquote(quoted: Column) -> Column:
    """The text in double quotes with its escapes resolved; only lines with a backslash go through Python."""
    inner = F.regexp_replace(quoted, r'^"|"$', "")
    return F.when(~F.contains(inner, F.lit("\\")), inner).otherwise(_unescape()(inner))


def _unescape():
    plain = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
    form = re.compile(r"\\(?:((?:x[0-9a-fA-F]{2})(?:\\x[0-9a-fA-F]{2})*)|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))", re.DOTALL)

    def one(m: re.Match) -> str:
        if m[1]:
            return bytes(int(x, 16) for x in re.findall(r"x(..)", m[1])).decode("utf-8", "replace")
        return chr(int(m[2] or m[3], 16)) if m[2] or m[3] else plain.get(m[4], m[4])

    @F.pandas_udf("string")
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else form.sub(one, t) if "\\" in t else t)

    return unescape
