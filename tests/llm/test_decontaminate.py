import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dirlens.llm import decontaminate as D
from dirlens.llm.common import word_hash


def words(t):
    return [w for w in re.split(rb"[\x00-/:-@\[-`{-\x7f]+", (t or "").encode().lower()) if w]


def grams(ws, k):
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def brute(docs, items, threshold=D.THRESHOLD):
    """Every passage against every item, by BM25 as it is written."""
    bags = [(i, t, Counter(words(t))) for i, t in dict.fromkeys(x for x in items if x[1]) if words(t)]
    n, mean = len(bags), sum(sum(b.values()) for *_, b in bags) / max(1, len(bags))
    df = Counter(w for *_, b in bags for w in b)
    half = max(32, max((sum(b.values()) for *_, b in bags), default=1))

    def impact(w, bag):
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * (D.K1 + 1) / (bag[w] + D.K1 * (1 - D.B + D.B * sum(bag.values()) / mean))

    out = set()
    for d, text in docs:
        ws = words(text)
        for a in range(0, len(ws), half):
            passage = ws[a : a + 2 * half]
            have = set(passage)
            for i, t, bag in bags:
                if sum(impact(w, bag) for w in bag if w in have) < (threshold - 1e-9) * sum(impact(w, bag) for w in bag):
                    continue
                ok = True
                for part, k, least in zip(D.split_item(t), (3, 2), (D.QUESTION, D.ANSWER), strict=True):
                    own = words(part)
                    k = min(k, len(own))
                    g = grams(own, k) if k else set()
                    ok &= not g or len(g & grams(passage, k)) / len(g) >= least
                if ok:
                    out.add((d, i))
    return out


def data(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)] + ["the"] * 60 + ["of"] * 40
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(4, 30))) + ". " + " ".join(rng.choices(vocab, k=rng.randint(1, 6))) + "?") for i in range(70)]
    items += [(70, None), (71, " ,. "), (72, "alone"), items[3], (73, items[4][1])]
    docs = []
    for d in range(90):
        ws = rng.choices(vocab, k=rng.randint(0, 200))
        if d % 2:
            own = rng.choice(items[:70])[1].split()
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            ws[rng.randrange(len(ws) + 1) : 0] = own
        docs.append((d, " ".join(ws).title() if d % 3 == 0 else ", ".join(ws)))
    return [*docs, (200, None), (201, ""), (202, items[5][1] * 300), docs[1], (None, items[6][1])], items


@pytest.mark.parametrize(("seed", "postings"), [(1, 10**6), (2, 600)])
def test_equals_brute_force(spark, monkeypatch, seed, postings):
    monkeypatch.setattr(D, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(D, "PASS_BYTES", 80_000)
    docs, items = data(seed)
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, score string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    dirty = {r.doc_id for r in got}
    left = D.drop_contaminated(d, b)
    assert left.columns == d.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted((x[0] for x in docs if x[0] not in dirty), key=str)
    assert D.find_contaminated(d.limit(0), b).count() == 0 and D.find_contaminated(d, b.limit(0)).count() == 0


def test_wand_finds_all(monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 2)
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices([f"v{j}" for j in range(25)], k=8))) for i in range(60)]
    bags = [set(t.split()) for _, t in items]
    df = Counter(w for b in bags for w in b)
    keyed = {word_hash(w): n for w, n in df.items()}
    index = D.build_index(items, {h: math.log(1 + 60 / n) for h, n in keyed.items()}, 8)
    for _ in range(50):
        q = rng.sample(sorted(df), rng.randint(1, 12))
        terms = np.unique(index.lookup(np.array([word_hash(w) for w in q], np.uint64)))
        for threshold in (0.2, 0.5, 0.8):
            full = Counter()
            for t in terms:
                for p in range(index.start[t], index.start[t + 1]):
                    full[int(index.items[p])] += index.share[p]
            assert sorted(i for i, _ in index.wand(terms, threshold)) == sorted(i for i, s in full.items() if s >= threshold - 1e-9)


def test_whole_item_is_found_in_a_long_text():
    items = [(1, "alpha beta gamma delta epsilon zeta. eta theta iota")]
    df = {word_hash(w): 1 for w in "alpha beta gamma delta epsilon zeta eta theta iota".split()}
    index = D.build_index(items, dict.fromkeys(df, 1.0), 9)
    texts = ["x " * k + items[0][1] + " y" * 50 for k in range(0, 100, 7)]
    assert all(h for h in D.find_in_texts(index, pa.array(texts), 0.5))
