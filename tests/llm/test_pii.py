import hashlib
import re
import time

from dirlens.llm.pii import KINDS, deobfuscate, detect, find_pii, luhn, spans


def brute(text):
    """The base patterns as stated, by plain finditer."""
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


TEXTS = [
    "", "a@b", "a.b@c.de", "x@y.z@w.v", "é@a.b ü.k@ex-ample.co.uk.", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-11112 5500005555555559",
    "+1 (988) 555-2485 in", "+1 2", "+12345678901234567", "++44 20 7946 0958-", "a" * 3000 + "@", "9" * 3000, "mail a@b.c,+49 30 1234567 and 10.0.0.1", "p@@q.r %@-.-", "1.1.1.1@2.2.2.2",
]


def test_base_is_as_stated():
    for t in TEXTS:
        assert detect(t) == brute(t), t


def test_disguises_map_back_to_the_source():
    for text, what, kind in [
        ("write jo (at) ex [dot] com now", "jo (at) ex [dot] com", "email"),
        ("write jo at ex dot com now", "jo at ex dot com", "email"),
        ("write jо@ехample.com now", "jо@ехample.com", "email"),
        ("call plus four nine three zero one two three four five six seven ok", "plus four nine three zero one two three four five six seven", "phone"),
        ("ip ten ０ １０.0.0.１ ok", "１０.0.0.１", "ip"),
        ("jo​@ex.com", "jo​@ex.com", "email"),
    ]:
        base, every = spans(text)
        assert (text.index(what), text.index(what) + len(what), kind) in every, (text, every)
        assert set(base) <= set(every) and base == brute(text)
    assert deobfuscate("look at the house, one two") is None or not spans("look at the house, one two")[1]


def test_operator_over_odd_rows(spark):
    rows = [(i, t, f"extra{i}") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "a@b.c", "y"), (2, TEXTS[2], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in find_pii(docs).collect()}
    assert find_pii(docs).count() == len(rows) and find_pii(docs.limit(0)).count() == 0
    for i, t in enumerate(TEXTS):
        told = ",".join(f"{k}:{a}:{b}" for a, b, k in brute(t))
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x[2] == k for x in brute(t)) for k in KINDS]
    assert got[99].spans == "" and got[None].n_email == 1


def test_digit_words_of_four_languages():
    for words in ("plus four nine three zero one two three four five six", "más uno dos tres cuatro cinco seis siete ocho nueve cero", "plus eins zwei drei vier fünf sechs sieben acht neun null", "plus zéro un deux trois quatre cinq six sept huit neuf"):
        assert spans(f"so {words}, so")[1] == [(3, 3 + len(words), "phone")]
    assert [x[2] for x in spans("jo arroba ex punto org, jo [ät] ex [punkt] de")[1]] == ["email", "email"]


def test_long_texts_take_linear_time():
    n = 1 << 20
    texts = ["a" + " " * n + "dot", "dot" + " " * n, "one two" + " " * n + "x", "(" + " " * n + "dot", "[at" + "] " * (n // 2), "1" * n + " one two", "a@b.cc " * (n // 32) + "j [at] b [dot] de"]
    for t in texts:
        began = time.process_time()
        spans(t)
        assert time.process_time() - began < 8, t[:20]


def test_added_spans_against_every_base_span():
    text = " ".join(["jo@ex.com", "four nine three zero one two", "bo (at) ex [dot] org", "+49 30 1234567"] * 50)
    base, every = spans(text)
    added = [x for x in every if x not in base]
    assert added and not any(x[2] == y[2] and x[0] < y[1] and y[0] < x[1] for x in added for y in base)
