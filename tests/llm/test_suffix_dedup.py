import random
from collections import defaultdict

import numpy as np
import pytest

from dirlens.llm.suffix_dedup import find_repeats, minimisers


def brute(rows, least):
    """Merged spans of words in any run of `least` words that another document holds too."""
    docs = list(dict.fromkeys((d, t) for d, t in rows if t))
    holders = defaultdict(set)
    split = []
    for i, (_, t) in enumerate(docs):
        at, parts = 0, []
        for w in t.split():
            at = t.index(w, at)
            parts.append((w.lower(), at, at + len(w)))
            at += len(w)
        split.append(parts)
        for j in range(len(parts) - least + 1):
            holders[tuple(p[0] for p in parts[j : j + least])].add(i)
    out = []
    for (d, _), parts in zip(docs, split, strict=True):
        spans = []
        for j in range(len(parts) - least + 1):
            if len(holders[tuple(p[0] for p in parts[j : j + least])]) > 1:
                if spans and spans[-1][1] >= j:
                    spans[-1][1] = j + least
                else:
                    spans.append([j, j + least])
        out += [(d, parts[a][1], parts[b - 1][2], b - a) for a, b in spans]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"wörd{i}" for i in range(300)]
    passages = [" ".join(rng.choices(vocab, k=k)) for k in (12, 13, 14, 20, 60, 4)]
    rows = []
    for d in range(120):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 40))) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randrange(4), rng.choice(passages) if rng.random() < 0.8 else passages[0].replace("rd", "RD"))
        rows.append((d, rng.choice(["\n", " ", "  \t"]).join(parts)))
    rows += [(d, passages[4] + " " + passages[3]) for d in range(200, 230)]
    rows += [(300, "tick tock " * 400), (301, "solo " * 900), (303, None), (304, ""), (305, passages[3]), (305, passages[3]), (None, passages[1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, start string").repartition(5)
    got = sorted([tuple(r) for r in find_repeats(docs, 12, 6).collect()], key=str)
    want = brute(rows, 12)
    assert all(any(d == e and a >= b and x <= y for e, b, y, _ in want) for d, a, x, _ in got)
    # a few words that two holders of a widely known passage share beside it may be left out
    assert all(any(d == e and a <= b + 60 and x >= y - 60 and n >= m - 5 for d, a, x, n in got) for e, b, y, m in want)
    assert len(got) == len(want) and sum(g == w for g, w in zip(got, want, strict=True)) >= 0.9 * len(want)


@pytest.mark.parametrize("core", [25, 32, 45, 49])
def test_matches_around_a_core_that_many_documents_hold(spark, core):
    rng = random.Random(core)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, rows = words(core), []
    for pair in range(60):
        k = rng.randint(50 - core, 73 - core)
        left = rng.randint(0, k)
        beside = words(left), words(k - left)
        rows += [(2 * pair + i, " ".join(words(30) + beside[0] + common + beside[1] + words(30))) for i in range(2)]
    rows += [(900, "tick tock " * 40 + "end"), (901, "tock " + "tick tock " * 200), (902, " ".join(words(30)) + " tick tock" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted([tuple(r) for r in find_repeats(docs).collect()], key=str) == brute(rows, 50)


def test_no_rows(spark):
    assert find_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_each_window_has_a_minimiser():
    rng = np.random.default_rng(1)
    for heads in (rng.integers(0, 1 << 60, 500).astype(np.uint64), np.zeros(200, np.uint64), np.tile(np.array([3, 1], np.uint64), 90)):
        at = minimisers(heads, 7)
        assert np.diff(at).max() <= 2 * 7 and at[0] < 7 and len(heads) - at[-1] <= 2 * 7
