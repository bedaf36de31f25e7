"""Groups of paths by glob rules: * is anything within a name, ** anything, and the most specific rule wins.

All rules are walked at once, so a path costs the same under ten rules and under ten thousand, and nothing is shuffled:
the group is a column. Rules too many to be held by each task are joined instead."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.functions import paths

#: Rules that a task holds: this many, and so many characters of globs and groups in all.
MOST_RULES, MOST_CHARS = 20_000, 2_000_000
#: Steps and directories remembered by a task before it starts afresh.
MOST_STEPS, MOST_DIRS = 1_000_000, 100_000
ONE, ANY = 1, 2  # the wildcards, and what a character matched by them counts; a literal one counts 0


class Machine:
    """The rules as a tree of literals and wildcards, walked for a path by character.

    A state is the set of places in the tree where a path may be, each with the rank of the best way to it: ways are
    compared from the left, a literal before * before **. So the ranks after a character follow from those before and
    from what it counts, and equal states have equal continuations: each step is worked out once and then looked up."""

    def __init__(self, rules: list[tuple[str, str | None]]):
        self.kids: list[dict] = [{}]
        self.kind = [0]  # 0 or the wildcard that a place stands for
        self.rule: list[tuple | None] = [None]
        for glob, group in rules:
            at = 0
            for token in re.findall(r"\*\*|\*|[^*]", glob):
                token = {"**": ANY, "*": ONE}.get(token, token)
                if token not in self.kids[at]:
                    self.kids[at][token] = len(self.kids)
                    self.kids.append({})
                    self.kind.append(token if isinstance(token, int) else 0)
                    self.rule.append(None)
                at = self.kids[at][token]
            self.rule[at] = (glob.count("*"), glob, group)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict] = []
        self.groups: list[str | None] = []
        self.known, self.dirs = 0, {}
        self.dead = self._state({})
        self.start = self._state({0: (0, 0)})

    def _state(self, best: dict) -> int:
        """The number of a state, given places and their ranks; wildcards that match nothing yet are entered."""
        todo = list(best)
        while todo:
            at = todo.pop()
            for token in (ONE, ANY):
                kid = self.kids[at].get(token)
                if kid is not None and best[at] < best.get(kid, (len(self.kids), 0)):
                    best[kid] = best[at]
                    todo.append(kid)
        # a rule that ends in ** takes whatever follows, so that worse ways can't win any more
        sure = min((r for at, r in best.items() if self.kind[at] == ANY and self.rule[at]), default=None)
        if sure is not None:
            best = {at: r for at, r in best.items() if r <= sure}
        ranks = {r: i for i, r in enumerate(sorted(set(best.values())))}
        key = tuple(sorted((at, ranks[r]) for at, r in best.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [(rank, *self.rule[at]) for at, rank in key if self.rule[at]]
            self.groups.append(min(ends, key=lambda e: e[:3])[3] if ends else None)
            self.known += len(key)
        return self.ids[key]

    def _step(self, state: int, ch: str) -> int:
        best: dict = {}

        def reach(at: int, way: tuple[int, int]) -> None:
            if at not in best or way < best[at]:
                best[at] = way

        for at, rank in self.states[state]:
            if ch in self.kids[at]:
                reach(self.kids[at][ch], (rank, 0))
            if self.kind[at] == ANY or (self.kind[at] == ONE and ch != "/"):
                reach(at, (rank, self.kind[at]))
        to = self._state(best)
        self.steps[state][ch] = to
        self.known += 1
        return to

    def _walk(self, state: int, text: str) -> int:
        steps = self.steps
        for ch in text:
            to = steps[state].get(ch)
            state = self._step(state, ch) if to is None else to
            if state == self.dead:
                break
        return state

    def group(self, path: str | None) -> str | None:
        if path is None:
            return None
        if self.known > MOST_STEPS or len(self.dirs) > MOST_DIRS:
            self.forget()
        cut = path.rfind("/") + 1
        above = path[:cut]
        state = self.dirs.get(above)
        if state is None:
            state = self.dirs[above] = self._walk(self.start, above)
        return self.groups[self._walk(state, path[cut:])]


def group_column(path: Column, rules: list[tuple[str, str | None]]) -> Column:
    """The group of the most specific rule (glob, group) that matches a path; null if none does or the path is null."""

    @F.pandas_udf("string")
    def group(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Machine(rules)
        for batch in batches:
            yield pd.Series([machine.group(p) for p in batch], dtype=object)

    return group(path)


def glob_group(rows: DataFrame, rules: DataFrame, column: str = "path") -> DataFrame:
    """rows with `glob_group`, the group of their path, null if no rule (rules: glob, group_name) matches.

    At the leftmost place where matching rules differ, a literal beats * and that beats **; of equal ones the rule with
    fewer wildcards wins, then the smaller glob. Rules of one glob are an error, those without a glob match nothing."""
    given = rules.where("glob IS NOT NULL").select("glob", "group_name")
    if not given.groupBy("glob").count().where("count > 1").isEmpty():
        raise ValueError("ambiguous glob rules")
    size = given.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("glob") + F.coalesce(F.length("group_name"), F.lit(0))), F.lit(0)).alias("chars")).first()
    if size.n > MOST_RULES or size.chars > MOST_CHARS:
        return glob_group_by_join(rows, given, column)
    return rows.withColumn("glob_group", group_column(F.col(column), sorted(map(tuple, given.collect()))))


def glob_pattern(glob: Column) -> Column:
    """A regex with a group for each wildcard: * within a name, ** anything."""
    quoted = F.regexp_replace(glob, r"([.+?^$\[\](){}|\\])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("([^/]*?)")), F.lit("\u0001"), F.lit("(.*?)")), F.lit(r"\z"))


def glob_group_by_join(rows: DataFrame, rules: DataFrame, column: str = "path") -> DataFrame:
    """What glob_group gives, for any number of rules: each is tried on the paths below the directory that it names."""
    shape = F.array_join(F.transform(F.regexp_extract_all("glob", F.lit(r"(\*\*|\*|[^*]+)"), F.lit(1)), lambda t: F.when(t == "**", "2").when(t == "*", "1").otherwise(F.regexp_replace(t, "(?s).", "0"))), "|")
    r = rules.select("glob", F.col("group_name").alias("glob_name"), glob_pattern(F.col("glob")).alias("re"), shape.alias("shape"), (F.length("glob") - F.length(F.replace("glob", F.lit("*"), F.lit("")))).alias("stars"))
    r = r.withColumn("__up", F.coalesce(F.nullif(F.regexp_extract("glob", "(?s)^([^*]*/)", 1), F.lit("")), F.lit("/")))
    own = rows.select(F.col(column).alias("__p")).distinct().withColumn("__dir", F.regexp_replace("__p", "[^/]+$", ""))
    near = own.select("__dir").distinct().withColumn("__up", F.explode(paths.ancestors(F.col("__dir")))).join(r, "__up").drop("__up")
    met = own.join(near, "__dir").where(F.expr("regexp_like(__p, re)"))
    # each wildcard stands for as many 1s or 2s as it matched characters
    filled = F.expr("aggregate(split(shape, '[|]'), named_struct('s', '', 'k', 1), (a, t) -> IF(t IN ('1', '2'), named_struct('s', concat(a.s, repeat(t, length(regexp_extract(__p, re, a.k)))), 'k', a.k + 1), named_struct('s', concat(a.s, t), 'k', a.k)), a -> a.s)")
    best = met.withColumn("line", filled).groupBy("__p").agg(F.min_by("glob_name", F.struct("line", "stars", "glob")).alias("glob_group"))
    return rows.withColumn("__p", F.col(column)).join(best, "__p", "left").drop("__p")
