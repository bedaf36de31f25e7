import zlib
from collections import defaultdict

import numpy as np
import pytest

from dirlens.llm.packing import pack, tokenize, windows
from dirlens.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def _docs():
    texts = ["Hello, World! it's 42", "", None, " \t\n", "über Straße — naïve…", "a" * 3000, "x\x1cy z", "don't DON'T 'll", "word " * 5000, "İstanbul ｆｕｌｌ é", "<|endoftext|> end", "Hello, World! it's 42"]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i}", 0, "x") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, "no id", None, None, None, None)]


def test_ids_are_the_tokenizers(path):
    enc = Encoder(path)
    assert enc.fast and enc.split
    for _, text, *_ in _docs():
        want = enc.whole.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(enc.ids(text or ""), enc.kind).tolist() == want, text


def test_each_id_lies_in_one_piece_and_sequences_are_full(spark, path):
    docs = spark.createDataFrame(_docs(), SCHEMA).repartition(3)
    got = pack(docs, path, sequence=64, window_tokens=256, keep_ids=True).collect()
    enc = Encoder(path)
    per_seq = defaultdict(list)
    for r in got:
        assert r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        per_seq[r.sequence_id].append((r.offset, r.length))
    sizes = {}
    for s, parts in per_seq.items():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        sizes[s] = end
    assert sorted(sizes) == list(range(len(sizes))) and all(n == 64 for s, n in sizes.items() if s != max(sizes)) and sizes[max(sizes)] <= 64
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, text, *_ in _docs():
        want = enc.whole.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[i], key=lambda r: r.start)
        copies = sum(x[0] == i for x in _docs())
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist()
        assert sorted(ids) == sorted(want * copies) and {r.doc_tokens for r in parts} == {len(want)}


def test_every_window_keeps_the_proportions(spark, path):
    rows = [(i, "one two three four five " * 4, "en", "big" if i % 4 else "small", 0, "") for i in range(2000)]
    queued = tokenize(spark.createDataFrame(rows, SCHEMA).repartition(5), path).cache()
    share = defaultdict(lambda: defaultdict(int))
    for r in queued.join(windows(queued, 1000), "row").collect():
        share[r.window][r.source] += r.n
    assert len(share) > 30
    for w, by in share.items():
        if w not in (0, max(share)):
            assert abs(by["small"] - 250) < 42 and abs(by["big"] - 750) < 42


def test_no_rows(spark, path):
    assert pack(spark.createDataFrame([], SCHEMA), path).count() == 0


def _mixed(spark, path, weights, window=1000):
    rows = [(i, "one two three four five " * 4, "en", ("big", "small", "odd")[0 if i % 5 else i // 5 % 2 + 1], 0, "") for i in range(2000)]
    queued = tokenize(spark.createDataFrame(rows, SCHEMA).repartition(5), path).cache()
    share, sent = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in queued.join(windows(queued, window, weights), "row").collect():
        share[r.window][r.source] += r.n
        sent[r.source] += r.n
    return share, sent


def test_weights_hold_until_a_source_is_dry_and_windows_stay_full(spark, path):
    for weights in ({"big": 0.2, "small": 0.8}, {"big": 1, "small": 4, "odd": 0, "none": 7}):
        share, sent = _mixed(spark, path, weights)
        dry = sent["small"] // 800
        weighted = -(-(sent["big"] + sent["small"]) // 1000)
        for w in range(1, weighted - 1):
            assert abs(sum(share[w].values()) - 1000) <= 84 and not share[w]["odd"]
            if w < dry - 1:
                assert abs(share[w]["small"] - 800) <= 42 and abs(share[w]["big"] - 200) <= 42
            if w > dry + 1:
                assert not share[w]["small"]
        assert sum(share[w]["odd"] for w in share if w >= weighted) == sent["odd"]


def test_weights_against_a_round_by_round_packer(spark, path):
    """A plain deficit round-robin with real queues gives each queue the same credit by the end of every round."""
    weights = {"big": 3, "small": 2, "odd": 1}
    share, sent = _mixed(spark, path, weights)
    left, got = dict(sent), defaultdict(float)
    for w in range(max(share) + 1):
        room = 1000.0
        while room > 1e-6 and any(v > 1e-6 for v in left.values()):
            live = {s: weights[s] for s, v in left.items() if v > 1e-6}
            step = min(room, *(v * sum(live.values()) / live[s] for s, v in left.items() if s in live))
            for s in live:
                left[s] -= step * live[s] / sum(live.values())
                got[s] += step * live[s] / sum(live.values())
            room -= step
        for s in sent:
            assert abs(sum(share[v][s] for v in range(w + 1)) - got[s]) <= 22


def test_weights_that_are_no_weights(spark, path):
    queued = tokenize(spark.createDataFrame(_docs(), SCHEMA), path)
    with pytest.raises(ValueError):
        windows(queued, 100, {"hot": -1.0})
    for weights in ({}, {"none": 3.0}, {"hot": 0.0}):
        assert windows(queued, 100, weights).count() == len(_docs())
