import hashlib
import random
from collections import Counter
from functools import reduce

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from dirlens.llm import alignment
from dirlens.llm.alignment import Fragment, align, aligner, chunks, fragment

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, block int"


def brute(rows):
    """Whole texts through both tokenizers, pairs listed one by one."""
    a, b = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    own = aligner(*FILES)
    docs = []
    for d, text in rows:
        raw = f" {text}".encode()
        x = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if not text or b"".join(own.a_bytes[i] for i in x) != raw or b"".join(own.b_bytes[i] for i in y) != raw:
            docs.append((d, 0, 0, [], Counter()))
            continue
        ends = [set(), set()]
        for k, (ids, held) in enumerate(((x, own.a_bytes), (y, own.b_bytes))):
            at = 0
            for i in ids:
                at += len(held[i])
                ends[k].add(at)
        edges, cut = sorted(ends[0] & ends[1]), []
        at_a = at_b = i = j = 0
        for e in edges:
            p, q = i, j
            while at_a < e:
                at_a, i = at_a + len(own.a_bytes[x[i]]), i + 1
            while at_b < e:
                at_b, j = at_b + len(own.b_bytes[y[j]]), j + 1
            cut.append((x[p:i], y[q:j]))
        docs.append((d, len(x), len(y), cut, Counter((s, t) for g in cut for s in g[0] for t in g[1])))
    held = Counter(p for *_, links in docs for p in links)
    most = {}
    for (s, _), n in held.items():
        most[s] = max(most.get(s, 0), n)
    out = []
    for d, n_a, n_b, cut, links in docs:
        text = ";".join(f"{','.join(map(str, s))}|{','.join(map(str, t))}" for s, t in cut)
        sha = hashlib.sha256(text.encode()).hexdigest() if cut else ""
        out.append((d, n_a, n_b, len(cut), sum(links.values()), sum(k for p, k in links.items() if held[p] == most[p[0]]), sum(k * held[p] for p, k in links.items()), sha))
    return sorted(out, key=str)


def _texts(rng, n):
    words = ["the", "Thing", "überß", "x1y2", "don't", "日本語", "a\nb", "#!?", "😀👍", "é", "www.example.com/a?b=c", "\t", "", "", "<|endoftext|>", "<s>", "\u0000", "12345", " ", "　", "\x1c", "\x85z"]
    return [" ".join(rng.choices(words, k=rng.randint(1, 60))) + rng.choice(["", " ", "\n", "  "]) for _ in range(n)]


def _same(spark, rows, parts=4):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(parts)
    assert sorted(map(tuple, align(df, *FILES).collect()), key=str) == brute(rows)


def test_short_texts_as_plain_pass(spark):
    rng = random.Random(3)
    rows = list(enumerate(_texts(rng, 150)))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "a▁b"), (None, "the thing"), (5, "again"), (5, "again"), (1004, "a "), (1005, "   "), (1006, "\n")]
    _same(spark, rows)


@pytest.mark.parametrize("chunk, near, fan", [(40, 12, 2), (9, 4, 3), (64, 64, 16)])
def test_chunked_texts_as_plain_pass(spark, monkeypatch, chunk, near, fan):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "NEAR", near)
    monkeypatch.setattr(alignment, "FAN", fan)
    rng = random.Random(chunk)
    rows = list(enumerate(_texts(rng, 40)))
    rows += [(100, "a" * 300), (101, "語" * 80 + " " + "ab" * 70), (102, "bad ▁ text " * 30), (103, "internationalisation " * 30), (103, "internationalisation " * 30)]
    _same(spark, rows)


def test_long_text_and_run_without_spaces(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 14))) for _ in range(900)]
    rows = [(1, " ".join(rng.choices(vocab, k=60_000))), (2, "=" * 100_000), (3, "".join(rng.choices("abcdef日本", k=90_000))), (4, "the end")]
    _same(spark, rows)


def test_fragments_compose_in_any_grouping():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 60)
        ends = [sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n))}) for _ in range(2)]
        ids = [[rng.randint(0, 9) for _ in e] for e in ends]
        whole = fragment(ids[0], ends[0], ids[1], ends[1], at_start=True)
        edges = sorted({0, n, *rng.sample(range(n + 1), rng.randint(0, min(n, 7)))})
        parts = []
        for c, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            inside = [[(i, e) for i, e in zip(x, y, strict=True) if low < e <= high] for x, y in zip(ids, ends, strict=True)]
            parts.append(fragment(*[[t[k] for t in x] for x in inside for k in (0, 1)], chunk=c))
        left = reduce(lambda x, y: x + y, parts)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts[0] == left and left.closed and left.suffix == ([], [])
        groups = [left.prefix, *[g[1:] for g in left.groups]]
        assert [tuple(g) for g in groups] == [tuple(g[1:]) for g in whole.groups]
    assert Fragment() + left == left


def test_chunks_cover_the_text_once(monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 20)
    monkeypatch.setattr(alignment, "NEAR", 6)
    rng = random.Random(6)
    for _ in range(200):
        text = " " + " ".join("é" * rng.randint(0, 9) + "b" * rng.choice([1, 3, 30]) for _ in range(rng.randint(1, 20)))
        parts = list(chunks(text))
        assert b"".join(t.encode()[a:b] for a, b, t in parts) == text.encode()


def test_empty_table(spark):
    assert align(spark.createDataFrame([], SCHEMA), *FILES).collect() == []
