"""Personal data with offset-preserving deobfuscation.

Two passes over each whole text, in one narrow Spark stage without a shuffle:
1. base patterns on the text as it is;
2. a transducer rewrites disguises (homoglyphs, invisible characters, spelled digits, at/dot words) and keeps for
   each character of its output the source span it came from; the same detectors run on the output and what they
   find is mapped back. Only spans that no base span of that kind overlaps are added, so base spans stay.

Nulls: a null text counts as empty; a null doc_id is carried through. Repeated rows give repeated results. Very long
texts are treated whole, in linear time. Spans that begin alike are in the order of KINDS, then by their ends.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As finditer, in linear time: a match has its local part right before an @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            done = m.end()
            yield m.span()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append((*m.span(), 2))
        if "+" in text:
            found += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


# Letters that look like ASCII ones (Cyrillic, Greek), and full-width forms; invisible characters.
_LOOKALIKE = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXaeopcyxijsdhlABEZHIKMNOPTYXo", strict=True))
_LOOKALIKE |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_INVISIBLE = "­​‌‍⁠﻿"
# The digits' names in English, Spanish, German and French, and the words for @ and the full stop.
_DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
)
_DIGIT_WORDS = {w: str(i) for names in _DIGIT_NAMES for i, w in enumerate(names.split())}
_AT, _DOT, _PLUS = "at|arroba|arobase|ät", "dot|punto|punkt|point", "plus|más"

_ODD = re.compile(f"[{_INVISIBLE}{''.join(_LOOKALIKE)}]")
_D = rf"(?:{'|'.join(sorted(_DIGIT_WORDS, key=len, reverse=True))})"
# Runs of white space are entered at their first character alone and never given back, so any text takes linear time.
_REWRITE = re.compile(
    rf"(?P<at>(?<!\s)\s*+[(\[{{<]\s*+(?:{_AT})\s*+[)\]}}>]\s*+|(?<=[A-Za-z0-9])\s++(?:{_AT})\s++(?=[A-Za-z0-9-]++(?:\s*+[(\[{{<]\s*+(?:{_DOT})\s*+[)\]}}>]|\s++(?:{_DOT})\s)))"
    rf"|(?P<dot>(?<!\s)\s*+[(\[{{<]\s*+(?:{_DOT})\s*+[)\]}}>]\s*+|(?<=[A-Za-z0-9])\s++(?:{_DOT})\s++(?=[A-Za-z0-9]))"
    rf"|(?P<digits>(?<!\w)(?:(?:{_PLUS})\s++)?{_D}(?:[\s-]++(?:{_D}|[0-9]++)(?!\w)){{2,}})",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W\d_]+|[0-9]")
_HINT = re.compile(rf"(?<!\w)(?:{_DOT})(?!\w)|[(\[{{<]\s*+(?:{_AT})(?!\w)|(?<!\w){_D}[\s-]++(?:{_D}|[0-9])", re.IGNORECASE)
_PLUSES = frozenset(_PLUS.split("|"))


def deobfuscate(text: str) -> tuple[str, list[int], list[int]] | None:
    """The text without disguises, and each of its characters' source start and end; None if it has none."""
    out: list[str] = []
    begin: list[int] = []
    end: list[int] = []
    changed = False

    if _ODD.search(text):
        changed = True
        for i, c in enumerate(text):
            if c not in _INVISIBLE:
                out.append(_LOOKALIKE.get(c, c))
                begin.append(i)
                end.append(i + 1)
        text = "".join(out)
    if not _HINT.search(text):
        return (text, begin, end) if changed else None

    src_begin, src_end = (begin, end) if changed else (range(len(text)), range(1, len(text) + 1))
    out, begin2, end2, last = [], [], [], 0
    for m in _REWRITE.finditer(text):
        out.append(text[last : m.start()])
        begin2 += src_begin[last : m.start()]
        end2 += src_end[last : m.start()]
        last = m.end()
        if m["digits"]:
            parts = [("+" if w[0].lower() in _PLUSES else _DIGIT_WORDS.get(w[0].lower(), w[0]), m.start() + w.start(), m.start() + w.end()) for w in _WORD.finditer(m[0])]
        else:
            parts = [("@" if m["at"] else ".", m.start(), m.end())]
        for c, a, b in parts:
            out.append(c)
            begin2.append(src_begin[a])
            end2.append(src_end[b - 1])
    if not last:
        return (text, begin, end) if changed else None
    out.append(text[last:])
    begin2 += src_begin[last:]
    end2 += src_end[last:]
    return "".join(out), begin2, end2


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, both in order; code points, end exclusive."""
    base = detect(text)
    if not (plain := deobfuscate(text)):
        return base, base
    clean, begin, end = plain
    extra = {(begin[a], end[b - 1], kind) for a, b, kind in detect(clean)}
    for kind in KINDS:  # a kind's base spans don't overlap, so the last that begins before a span's end decides
        own = [x for x in base if x[2] == kind]
        starts = [x[0] for x in own]
        extra = {x for x in extra if x[2] != kind or not (i := bisect_left(starts, x[1])) or own[i - 1][1] <= x[0]}
    return base, sorted([*base, *extra], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _told(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts and digest of the base spans, all spans, and how many the method added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, every = spans(text.as_py() or "")
                n = [sum(x[2] == k for x in base) for k in KINDS]
                rows.append((i, *n, hashlib.sha256(_told(base).encode()).hexdigest(), _told(every), len(every) - len(base)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            names = [x.split()[0] for x in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _OUT)
