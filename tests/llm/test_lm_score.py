import random
from collections import Counter

import numpy as np
import pytest

from dirlens.llm import lm_score as L
from dirlens.llm.common import word_hash


def _net(classes=7, hidden=5):
    net = L.Network(classes, hidden, seed=3)
    net.flat = net.flat.astype(np.float64)
    return net


def test_gradient_and_log_probs():
    net, rng = _net(), np.random.default_rng(0)
    ids, first = rng.integers(0, 7, 12), np.array([0, 5, 5, 12])
    ctx = net.contexts(ids, first)
    place, out, bias = net.parts()
    for i in range(12):
        a, b = (0, 5) if i < 5 else (5, 12)
        around = [ids[i + s] if a <= i + s < b else 7 for s in (-2, -1, 1, 2)]
        assert ctx[i].tolist() == around
        z = np.tanh(sum(place[s][c] for s, c in enumerate(around))) @ out + bias
        assert net.log_probs(ctx, ids, 5)[i] == pytest.approx(z[ids[i]] - np.log(np.exp(z).sum()))
    g = net.gradient(ctx, ids)
    for k in rng.integers(0, len(net.flat), 40):
        loss = []
        for d in (1e-5, -1e-5):
            net.flat[k] += d
            loss.append(-net.log_probs(ctx, ids).mean())
            net.flat[k] -= d
        assert g[k] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-4)


def _corpus(n=400):
    rng = random.Random(2)
    nouns, verbs = [f"noun{i}" for i in range(15)], [f"verb{i}" for i in range(15)]
    return [(i, " ".join(f"the {rng.choice(nouns)} will {rng.choice(verbs)} a {rng.choice(nouns)} ." for _ in range(rng.randint(3, 30)))) for i in range(n)]


def test_order_is_learnt_and_odd_rows(spark):
    docs, rng = _corpus(), random.Random(5)
    mixed = []
    for i, t in docs[:60]:
        ws = t.split()
        rng.shuffle(ws)
        mixed.append((10_000 + i, " ".join(ws)))
    odd = [(20_000, None), (20_001, ""), (None, "the noun1 will"), docs[0], (20_002, "zzz " * 30_000)]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs + mixed + odd], "doc_id long, text string, log_prob double").repartition(3)
    got = L.score_documents(df).collect()
    assert len(got) == len(docs) + len(mixed) + len(odd)
    by = {r.doc_id: r for r in got}
    assert sum(by[i].mean_log_prob > by[10_000 + i].mean_log_prob for i, _ in docs[:60]) >= 57
    assert all(r.log_prob <= 0 and (r.n_words == 0 or r.mean_log_prob == pytest.approx(r.log_prob / r.n_words)) for r in got)
    assert (by[20_000].n_words, by[20_000].log_prob, by[20_000].mean_log_prob) == (0, 0, None) and by[20_002].n_words == 30_000


def test_no_rows_and_trees_of_means(spark, monkeypatch):
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    monkeypatch.setattr(L, "FAN_IN", 2)
    df = spark.createDataFrame(_corpus(60), "doc_id long, text string").repartition(5)
    assert L.score_documents(df, 1).count() == 60


def test_scores_do_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_WORDS", 3000)
    docs = _corpus(150)
    told = [{r.doc_id: r.log_prob for r in L.score_documents(spark.createDataFrame(d, "doc_id long, text string").repartition(n), 2).collect()} for d, n in ((docs, 2), (docs[::-1], 7))]
    assert told[0] == pytest.approx(told[1], rel=1e-5)


def test_scores_against_a_plain_pass(spark, monkeypatch):
    """All of it again in plain Python, with the trained weights: classes, contexts, shares and sums."""
    docs = [*_corpus(80), (900, "The noun1 unseen"), (901, "odd words here only")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    nets, train = [], L.train
    monkeypatch.setattr(L, "FREQUENT", 20)
    monkeypatch.setattr(L, "vocabulary", lambda texts, counts, f=L.vocabulary: f(texts, 20, 32, counts))
    monkeypatch.setattr(L, "train", lambda *a: nets.append(train(*a)) or nets[0])
    got = {r.doc_id: r.log_prob for r in L.score_documents(df, 1).collect()}
    counts = Counter(w for _, t in docs for w in t.lower().split())
    signed = {w: int(np.uint64(word_hash(w)).astype(np.int64)) for w in counts}
    top = sorted(counts, key=lambda w: (-counts[w], signed[w]))[:20]
    hashes = sorted(word_hash(w) for w in top)
    cls = {w: hashes.index(word_hash(w)) if w in top else 20 + word_hash(w) % 32 for w in counts}
    size = Counter()
    for w, n in counts.items():
        size[cls[w]] += n
    place, out, bias = (p.astype(np.float64) for p in nets[0].parts())
    for d, t in docs:
        words, total = t.lower().split(), 0.0
        for i, w in enumerate(words):
            around = [cls[words[i + s]] if 0 <= i + s < len(words) else nets[0].classes for s in (-2, -1, 1, 2)]
            z = np.tanh(sum(place[s][c] for s, c in enumerate(around))) @ out + bias
            total += z[cls[w]] - z.max() - np.log(np.exp(z - z.max()).sum()) + (0 if w in top else np.log(counts[w] / size[cls[w]]))
        assert got[d] == pytest.approx(min(total, 0), rel=1e-4), d


def test_vocabulary_counts(spark):
    df = spark.createDataFrame([(1, "a a A b\tc"), (2, None), (3, "b d")], "doc_id long, text string")
    v = L.vocabulary(df.fillna({"text": ""}), 2, 4)
    assert sorted(v.count[:2]) == [2, 3] and v.count[2:].round().sum() >= 2 and v.distinct.sum() >= 4


@pytest.mark.parametrize("known", [0, 1 << 16])
def test_each_word_has_its_own_probability(spark, monkeypatch, known):
    monkeypatch.setattr(L, "KNOWN", known, raising=False)
    monkeypatch.setattr(L, "vocabulary", lambda texts, counts, f=L.vocabulary: f(texts, 96, L.BUCKETS, counts))
    words = [f"word{i}" for i in range(400)]
    bucket = lambda w: word_hash(w) % L.BUCKETS
    rng = random.Random(3)
    docs = [" ".join(rng.choices(words[:100], k=400) + rng.choices(words[100:], k=100)) for _ in range(40)]
    common = "often"
    garbles = [g for g in (f"garble{i}" for i in range(500)) if bucket(g) == bucket(common)][:2]
    docs += [" ".join([*words[100:110], w, *words[110:120]]) for w in [common] * 20 + garbles]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.log_prob for r in L.score_documents(df, 1).collect()}
    assert got[60] == pytest.approx(got[61]) and got[40] - got[60] == pytest.approx(np.log(20), abs=1e-6)


def test_all_positions_are_trained_on():
    assert {r % L.SLICES for r in range(L.ROUNDS)} == set(range(L.SLICES))
