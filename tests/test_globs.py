"""Glob rules: the machine against the join and against all alignments, its cost, and its edges."""

import functools
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dirlens.operators import globs

RULES = "glob string, group_name string"


def lines(glob, path):
    """Every way in which a glob makes a path, as a text of what each character counts."""

    @functools.cache
    def go(i, j):
        if i == len(glob):
            return frozenset([""] if j == len(path) else [])
        if glob[i] != "*":
            return frozenset("0" + x for x in go(i + 1, j + 1)) if j < len(path) and glob[i] == path[j] else frozenset()
        n, mark = (2, "2") if glob.startswith("**", i) else (1, "1")
        out = set(go(i + n, j))
        if j < len(path) and (mark == "2" or path[j] != "/"):
            out |= {mark + x for x in go(i, j + 1)}
        return frozenset(out)

    return go(0, 0)


def best(rules, path):
    ways = [(min(w), g.count("*"), g) for g in rules if (w := lines(g, path))]
    return min(ways)[2] if ways else None


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab/*", min_size=1, max_size=7), max_size=8), st.lists(st.text("ab/*c\n", max_size=8), max_size=8))
def test_machine_finds_the_best_alignment(rules, paths):
    machine = globs.Machine([(g, g) for g in rules])
    for p in paths:
        assert machine.group(p) == best(rules, p), (rules, p)


def test_machine_that_forgets(monkeypatch):
    monkeypatch.setattr(globs, "MOST_STEPS", 5)
    monkeypatch.setattr(globs, "MOST_DIRS", 1)
    rules = ["/a/**", "/**.bam", "/a/*/b*"]
    machine = globs.Machine([(g, g) for g in rules])
    for p in ["/a/x/b.bam", "/q/r.bam", "/a/", "/z", "/a/x/b"] * 2:
        assert machine.group(p) == best(rules, p)


def test_rows_nulls_and_more_columns(spark):
    rows = spark.createDataFrame([("/x/1", 1), (None, 2), ("/x/1", 3), ("", 4)], "path string, glob long")
    rules = spark.createDataFrame([("/x/*", "x"), (None, "none"), ("/**", None)], RULES)
    for f in (globs.glob_group, globs.glob_group_by_join):
        got = f(rows, rules)
        assert sorted((r.glob, r.glob_group) for r in got.collect()) == [(1, "x"), (2, None), (3, "x"), (4, None)]
    assert globs.glob_group(rows.limit(0), rules).count() == 0
    assert {r.glob_group for r in globs.glob_group(rows, rules.limit(0)).collect()} == {None}
    with pytest.raises(ValueError, match="ambiguous"):
        globs.glob_group(rows, rules.union(rules))


def test_join_of_many_rules_is_equal(spark, monkeypatch):
    names = ["a", "b", "ab", "tmp", "x.bam", "long name"]
    paths = [f"/{p}/{q}/{r}" for p in names for q in names for r in names]
    some = [f"/{p}/{q}" for p in ("a", "*", "**", "a*", "**b") for q in ("**", "tmp/*", "**.bam", "*/x*")]
    rules = spark.createDataFrame([(g, g) for g in some], RULES)
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    one = {r.path: r.glob_group for r in globs.glob_group(rows, rules).collect()}
    monkeypatch.setattr(globs, "MOST_RULES", 3)
    assert one == {r.path: r.glob_group for r in globs.glob_group(rows, rules).collect()}
    assert one["/a/tmp/x.bam"] == best(some, "/a/tmp/x.bam")


def test_no_shuffle_in_the_plan(spark):
    rules = spark.createDataFrame([("/x/*", "x")], RULES)
    plan = globs.glob_group(spark.range(9).selectExpr("concat('/x/', id) AS path"), rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_a_thousand_rules_cost_as_few_do():
    paths = [f"/disk/d{i % 50}/p{i % 977}/s{i % 13}/file{i}.{'bam' if i % 3 else 'txt'}" for i in range(60_000)]

    def seconds(n):
        machine = globs.Machine([(g, g) for i in range(n // 5) for g in (f"/**/p{i}/**", f"/**.t{i}", f"/disk/d{i}/**", f"/*/d{i}/*/s*/**.bam", f"/**/s{i}/*.txt")])
        at = time.perf_counter()
        for p in paths:
            machine.group(p)
        return time.perf_counter() - at

    few, many = (min(seconds(n) for _ in range(2)) for n in (10, 1000))
    print(few, many)
    assert many < 4 * few
