import random
import re
from collections import defaultdict

from dirlens.llm.line_dedup import CELLS, DEPTHS, LEAST_EXACT, LEAST_NODE, SHORT, dedup_lines


def tokens(line):
    return [re.sub(r"^.*[0-9].*$", "<*>", x, flags=re.DOTALL) for x in line.split(" ")]


def keys(line):
    t = tokens(line)
    n = len(t)
    out = [("exact" if n >= SHORT else "short", tuple(t))] if any(c.isalpha() for x in t for c in x) else []
    return out + [("node", n, tuple(t[:d])) for d in DEPTHS if n > d]


def constant(node, lines):
    """Whether half of the runs behind the node's leading tokens are the same in all lines."""
    _, n, head = node
    c = min(CELLS, n)
    cut = [i * n // c for i in range(c + 1)]
    runs = [i for i in range(c) if cut[i] >= len(head)]
    seen = [{tuple(t[cut[i] : cut[i + 1]]) for t in map(tokens, lines)} for i in runs]
    return bool(runs) and 2 * sum(len(s) == 1 and set(*s) != {"<*>"} for s in seen) >= len(runs)


def brute(rows):
    order = lambda d: (d is None, d or 0)
    docs, lines = defaultdict(set), defaultdict(set)
    for d, text, *_ in rows:
        for line in text.split("\n") if text is not None else ():
            for k in keys(line):
                docs[k].add(order(d))
                lines[k].add(line)
    least = {"exact": LEAST_EXACT, "short": LEAST_NODE, "node": LEAST_NODE}
    bad = {k: min(s) for k, s in docs.items() if len(s) >= least[k[0]] and (k[0] != "node" or constant(k, lines[k]))}
    out = []
    for d, text, *_ in rows:
        kept = None if text is None else "\n".join(x for x in text.split("\n") if not any(k in bad and order(d) > bad[k] for k in keys(x)))
        out.append((d, kept))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(4)
    vocab = [f"word{chr(97 + i)}" for i in range(26)]
    shared = [" ".join(rng.choices(vocab, k=k)) for k in (1, 2, 3, 5, 12, 60)]
    rows = []
    for d in range(60):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(0, 20))) for _ in range(rng.randint(0, 6))]
        lines += rng.sample(shared, rng.randint(0, 3))
        if rng.random() < 0.5:
            lines.append(f"page {d} of {d * 7} was seen at 10:{d} by user{d} today")
        if rng.random() < 0.4:
            lines.append(f"the visitor named {rng.choice(vocab)} {rng.choice(vocab)} came in and left with a book in hand")
        if rng.random() < 0.4:
            lines.append(f"Posted by {rng.choice(vocab)} {rng.choice(vocab)} in News")
        lines += rng.sample(["Read more", "Share", "12", "---", f"Only {rng.choice(vocab)}"], 2)
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines), "en", f"src{d % 3}", 7))
    rows += [(60, None, None, None, None), (61, "", "en", "s", 0), (None, "\n".join(shared), "en", "s", 0), (63, "x" * 100000 + " 1\n" + "ab " * 30000, "en", "s", 0), (64, "ab " * 30000, "en", "s", 0)]
    return [*rows, rows[4], (4, "other text\n" + shared[4], "en", "s", 0), (70, " a  b   c\r\n\n\n" + shared[4] + " ", "en", "s", 1), (71, " a  b   c\r", "en", "s", 1)]


def test_equals_brute_force(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_lines string, n_chars long").repartition(3)
    got = dedup_lines(docs).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == brute(rows)
    for r in got:
        assert r.n_lines - r.n_dropped == (0 if r.text is None else len(r.text.split("\n")) if r.n_lines > r.n_dropped else 0)


def _kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in dedup_lines(docs).orderBy("doc_id").collect()]


def test_words_as_fields_of_short_lines(spark):
    names = ["Alice Smith", "Carol Jones", "Erin Brown", "Alice Green"]
    assert _kept(spark, [f"own {'xyzw'[i]}{'abcd'[i]}\nPosted by {n} in News" for i, n in enumerate(names)]) == ["own xa\nPosted by Alice Smith in News", "own yb", "own zc", "own wd"]
    assert _kept(spark, [f"own{x}\nRead more" for x in "abc"]) == ["owna\nRead more", "ownb", "ownc"]
    assert _kept(spark, ["a\nRead more", "b\nRead more"]) == ["a\nRead more", "b\nRead more"]


def test_lines_that_begin_alike_stay(spark):
    texts = ["the old house stood near a river", "the old road turned off into woods", "the old ship came home with fish"]
    assert _kept(spark, texts) == texts


def test_columns_of_any_name_pass_through(spark):
    names = ["gone", "d", "th", "__d", "__th", "__kept", "key", "lines", "x", "i", "l", "least", "drop", "a.b"]
    rows = [(i, "same line of text here\nown" + "abc"[i], *range(len(names))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = dedup_lines(docs).orderBy("doc_id").collect()
    assert [tuple(r)[: len(names) + 2] for r in got] == [(i, ("same line of text here\n" if i == 0 else "") + "own" + "abc"[i], *range(len(names))) for i in range(3)]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert dedup_lines(docs).columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"] and dedup_lines(docs).count() == 0


def test_many_dropped_lines_of_long_texts(spark):
    """Linear in a text's lines: with a search among the dropped ones for each line this takes minutes."""
    lines = [f"w{chr(97 + i % 26)}{'xyz'[i % 3]}{i // 7}q line that both texts have" for i in range(50_000)]
    own = [f"only here {'abcdefghij'[i % 10]}" for i in range(5)]
    second = own[:2] + lines[:25_000] + own[2:4] + lines[25_000:] + own[4:]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(second))], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert got[1].n_dropped == 0 and got[1].text == "\n".join(lines)
    assert got[2].text == "\n".join(own) and got[2].n_dropped == 50_000
