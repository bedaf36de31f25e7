import math
import random
import zlib

import pytest

from dirlens.llm.toxicity import FEATURES, SECOND_PERSON, _Memo, drop_toxic, features, score_toxicity, units

BAD = ["moron", "loweixa", "loweiyb", "loweizc"]


def _data(n=900, seed=3):
    rng = random.Random(seed)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(1, 60))
        toxic = int(rng.random() < 0.2)
        if toxic:
            words[rng.randrange(len(words)) : 0] = [rng.choice(BAD)]
        docs.append((i, " ".join(words), "en", f"s{toxic}", 0.5))
        labels.append((i, 1, toxic))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string, score double"


def test_held_out_rows_and_odd_ones(spark):
    docs, labels = _data()
    # the held-out rows' labels are reversed: a scorer that reads them can't get the rest right
    lies = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    odd = [(5000, None, None, None, None), (5001, "", "en", "x", 0.1), (None, "you moron", "en", "x", 0.1), docs[0], (5002, "word " * 40000, "en", "x", 0.0)]
    got = score_toxicity(spark.createDataFrame(docs + odd, SCHEMA).repartition(3), spark.createDataFrame([*lies, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = sum(r.predicted == truth.get(r.doc_id, 0) for r in held) / len(held)
    assert right > 0.97
    assert {r.doc_id: r.predicted for r in got}[5001] == 0


def test_without_labels_or_rows(spark):
    docs, labels = _data(20)
    d, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_toxicity(d, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_toxicity(d, one).collect()} == {1.0}
    assert score_toxicity(d.limit(0), none).count() == 0


def test_features():
    memo = _Memo({"moron": 3.0, "lowei*": 2.0})
    f = dict(zip(FEATURES, features("YOU are a m0ron! Loweixyz", memo), strict=True))
    assert f["peak"] == 3 and f["hits"] > 1 and f["nearness"] == 1 / 4 and f["obfuscation"] == 0.2 and f["shouting"] > 0 and f["capitals"] > 0
    assert features("", memo) == [0.0] * len(FEATURES)
    assert units("abcdef,xy")[0] == ["abcdef", "abcd*", "abcde*", "xy"]


def _plain(text, lexicon):
    """The features as their names say, token by token and sign by sign."""
    tokens, data = text.split(), text.encode(errors="replace")
    if not tokens:
        return [0.0] * len(FEATURES)
    told = [units(t) for t in tokens]
    weights = [max((lexicon.get(k, 0.0) for k in keys), default=0.0) for keys, _ in told]
    hits = [i for i, w in enumerate(weights) if w > 0]
    second = [i for i, (keys, _) in enumerate(told) if SECOND_PERSON & set(keys)]
    gap = min((abs(a - b) for a in hits for b in second), default=None)
    capitals, small = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
    signs = [b for b in data if 33 <= b < 127 and not chr(b).isalnum()]
    loud = sum(b in b"!?" for b in signs)
    n = len(tokens)
    return [
        max(weights), sum(weights) / n, len(hits) / n, math.log1p(len(hits)), 0.0 if gap is None else 1 / (1 + gap), len(second) / n, capitals / max(1, capitals + small),
        sum(len(t) > 2 and t.isupper() for t in tokens) / n, len(signs) / len(data), loud / len(data), sum(m for _, m in told) / n, sum(48 <= b <= 57 for b in data) / len(data), math.log1p(n),
    ]


def test_features_against_a_plain_pass():
    rng = random.Random(8)
    pool = ["you", "YOU", "moron", "m0ron!", "Loweixyz", "du", "ça", "7up", "--", "LOUD", "a", "x.y", "é", "stop!?", "votre", "um"]
    lexicon = {"moron": 3.25, "lowei*": 2.0, "stop": 1.5}
    for n in (0, 1, 2, 3, 5, 40, 400):
        for _ in range(20):
            text = rng.choice([" ", "  ", "\n"]).join(rng.choices(pool, k=n))
            assert features(text, _Memo(lexicon)) == pytest.approx(_plain(text, lexicon), abs=1e-12), text


def test_filter_keeps_columns_of_any_name(spark):
    docs, labels = _data()
    wide = [(*d, i, i + 1, i + 2) for i, d in enumerate(docs)]
    df = spark.createDataFrame(wide, SCHEMA + ", predicted long, held_out long, id long")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = drop_toxic(df, told)
    assert kept.columns == df.columns
    fine = {r.doc_id for r in score_toxicity(df, told).collect() if not r.predicted}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == fine and 500 < len(rows) < len(docs) and all(tuple(r) in set(wide) for r in rows)
    assert drop_toxic(df, told.limit(0)).count() == len(docs)
