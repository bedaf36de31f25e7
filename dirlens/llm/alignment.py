"""Alignment of two tokenizers over the same bytes, as an associative monoid of fragments.

A byte range of a document is a fragment: an open prefix (tokens before its first common end), closed groups, and an
open suffix. A token belongs to the range in which it ends. Two neighbouring fragments compose by closing the group
that the left one's suffix and the right one's prefix make; that is associative, so fragments of a long document are
composed in a tree, FAN at a time, in any tasks. Only open ends and the groups they make travel; closed groups stay.

Texts are tokenized in units: white space ahead of a space parts no unit, any other character does, since neither
tokenizer joins such a character with the space behind it. (Whether that holds is read off the vocabularies; if not, a
text is one unit.) A unit's tokens, groups and links are found once for each worker and unit. Documents of up to
CHUNK characters are one fragment each; longer ones are cut every CHUNK characters, inside units too, and each chunk
is sent with the whole of the units at its ends. A unit that is cut is tokenized in both chunks, and one of more than
2 * NEAR characters around the cut is left to the chunk on its left.

Counts of id pairs (in how many documents a pair is linked) are summed up within blocks of documents of some 2 MB of
text, then over blocks. A block gets back the counts of its own pairs. Nothing is sent to all tasks.

Nulls: texts that are null, empty, or that a tokenizer doesn't give back byte for byte have no tokens: zeros, and an
empty groups_sha256. Null doc_ids are carried. Repeated rows are documents of their own, and count so. Ties for the
highest count all are best. Very long texts are chunked as told; a unit without spaces is tokenized in one task.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored
from .tokens import byte_letters

CHUNK, NEAR, FAN, MOST_HELD, AT_ONCE = 1 << 16, 1 << 10, 16, 1 << 26, 1 << 18
_CUT = re.compile(r"(?<=\S)(?= )")


@dataclass
class Fragment:
    """Tokens (A's, B's) of a byte range. `closed` says whether it has a common end (or begins at one)."""

    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    closed: bool = False
    groups: list[tuple[int, list[int], list[int]]] = field(default_factory=list)  # with the chunk they are closed in
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    first: int = 0  # the chunk in which the prefix is closed

    def __add__(self, right: Fragment) -> Fragment:
        if not right.closed:
            if not self.closed:
                return Fragment(_joined(self.prefix, right.prefix))
            return Fragment(self.prefix, True, self.groups, _joined(self.suffix, right.prefix), self.first)
        if not self.closed:
            return Fragment(_joined(self.prefix, right.prefix), True, right.groups, right.suffix, right.first)
        a, b = _joined(self.suffix, right.prefix)
        seam = [(right.first, a, b)] if a or b else []
        return Fragment(self.prefix, True, self.groups + seam + right.groups, right.suffix, self.first)


def _joined(x: tuple[list[int], list[int]], y: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    return x[0] + y[0], x[1] + y[1]


def fragment(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int], chunk: int = 0, at_start: bool = False) -> Fragment:
    """The fragment of tokens with the bytes where they end."""
    out, i, j, p, q = Fragment(closed=at_start, first=chunk), 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if a_ends[i] < b_ends[j]:
            i += 1
        elif a_ends[i] > b_ends[j]:
            j += 1
        else:
            i, j = i + 1, j + 1
            group = (a[p:i], b[q:j])
            if out.closed:
                out.groups.append((chunk, *group))
            else:
                out.prefix, out.closed = group, True
            p, q = i, j
    rest = (a[p:], b[q:])
    if out.closed:
        out.suffix = rest
    else:
        out.prefix = rest
    return out


def group_text(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def add_links(links: Counter, a: list[int], b: list[int]) -> None:
    """All pairs of a group, as a << 32 | b; equal ids are multiplied out, not listed."""
    if len(a) == 1 and len(b) == 1:
        links[a[0] << 32 | b[0]] += 1
        return
    other = Counter(b).items()
    for x, m in Counter(a).items():
        for y, k in other:
            links[x << 32 | y] += m * k


class Aligner:
    """Both tokenizers, and what is known of units."""

    def __init__(self, byte_level: str, by_piece: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=by_piece)
        self.a.encode_special_tokens = True
        letters = {letter: byte for byte, letter in byte_letters().items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        plain = [p for i, p in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        probe = ["on", "b.", "9", "é", "ß!", "語"]
        parted = all(self._a(f" {x} {y}") == self._a(f" {x}") + self._a(f" {y}") for x in probe for y in probe)
        self.units = parted and not any(re.search("[^▁]▁", p) for p in plain)
        self.space = self.b.piece_to_id("▁")
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # how an id is written inside and at the end of its side of a group: A's, then B's
        ids = [f"{i}{end}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(n)]
        self.written, self.written_sizes = ids, np.array(list(map(len, ids)), np.int64)
        self.forget()

    def _a(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def cut(self, text: str) -> list[str]:
        """The units of a text that begins with a space."""
        return _CUT.split(text) if self.units else [text]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.text, self.text_at = bytearray(), array("q", [0])
        self.numbers = array("q")  # per unit: whether it is whole, A's tokens, B's tokens, groups, links
        self.at, self.pairs, self.times = array("q", [0]), array("q"), array("q")

    def tokens(self, units: list[str]) -> Iterator[tuple[bool, list[int], list[int], list[int], list[int]]]:
        """Per unit: whether both tokenizers give its bytes back; A's ids and ends, B's ids and ends."""
        a_ids = self.a.encode_batch(units, add_special_tokens=False)
        b_ids = self.b.encode([u[1:] for u in units], num_threads=1)
        for unit, a, b in zip(units, a_ids, b_ids, strict=True):
            a, b, raw = a.ids, b if len(unit) > 1 else [self.space], unit.encode()
            a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
            whole = b"".join(a_bytes) == raw and b"".join(b_bytes) == raw
            yield whole, a, np.cumsum(list(map(len, a_bytes))).tolist(), b, np.cumsum(list(map(len, b_bytes))).tolist()

    def learn(self, units: set[str]) -> None:
        """Keep what is to know of units; beyond MOST_HELD bytes or so, of these alone."""
        if self.held > MOST_HELD:
            self.forget()
        new, odd, size = [], [], 0
        for unit in units:
            if unit in self.known:
                continue
            # what can't stand before another unit, is long, or may be given back changed, is looked at alone
            if len(unit) > NEAR or unit[-1].isspace() or "▁" in unit:
                odd.append(unit)
                continue
            new.append(unit)
            size += len(unit)
            if size > AT_ONCE:
                odd += self._learn_joined(new)
                new, size = [], 0
        odd += self._learn_joined(new) if new else []
        for unit, (whole, a, a_ends, b, b_ends) in zip(odd, self.tokens(odd) if odd else (), strict=True):
            groups = fragment(a, a_ends, b, b_ends, at_start=True).groups if whole else []
            links: Counter = Counter()
            for _, x, y in groups:
                add_links(links, x, y)
            text = "".join([f"{group_text(x, y)};" for _, x, y in groups]).encode()
            pair, times = np.array(list(links.keys()), np.int64), np.array(list(links.values()), np.int64)
            self._keep([unit], np.array([[whole, len(a), len(b), len(groups), times.sum()]]), text, np.array([len(text)]), pair, times, np.array([len(pair)]))

    def _keep(self, units: list[str], numbers: np.ndarray, text: bytes, text_ends: np.ndarray, pair: np.ndarray, times: np.ndarray, pair_ends: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(units, range(n, n + len(units)), strict=True))
        self.text_at.frombytes((text_ends + len(self.text)).astype(np.int64).tobytes())
        self.at.frombytes((pair_ends + len(self.pairs)).astype(np.int64).tobytes())
        self.text += text
        self.numbers.frombytes(numbers.astype(np.int64).tobytes())
        self.pairs.frombytes(pair.astype(np.int64).tobytes())
        self.times.frombytes(times.astype(np.int64).tobytes())
        self.held += 200 * len(units) + sum(map(len, units)) + len(text) + 16 * len(pair)

    def _learn_joined(self, units: list[str]) -> list[str]:
        """Learn units as one text, in which they come out as they do alone; those to look at alone instead."""
        joined = "".join(units)
        raw = joined.encode()
        a, b = np.array(self._a(joined), np.int64), np.array(self.b.encode(joined[1:]), np.int64)
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != raw or b"".join([self.b_bytes[i] for i in b.tolist()]) != raw:
            return units
        ends = np.cumsum([len(u.encode()) for u in units])
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not np.isin(ends, common, assume_unique=True).all():
            return units
        unit_of = np.searchsorted(ends, common)
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        n_a, n_b = np.bincount(a_group), np.bincount(b_group)
        per_unit = lambda of: np.bincount(of, minlength=len(units))
        # every A token with all B tokens of its group
        many = n_b[a_group]
        first_b = (np.cumsum(n_b) - n_b)[a_group]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first_b, many)
        item, pair, times = summed(np.repeat(unit_of[a_group], many), np.repeat(a, many) << 32 | b[place], np.ones(len(place), np.int64))
        # the groups as text: A's ids of a group, then B's
        last_a, last_b = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
        n, m = len(self.a_bytes), len(self.b_bytes)
        written = np.concatenate([a + n * last_a, 2 * n + b + m * last_b])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        written = written[order]
        text = b"".join([self.written[i] for i in written.tolist()])
        told = np.concatenate([unit_of[a_group], unit_of[b_group]])[order]
        text_ends = np.cumsum(np.bincount(told, self.written_sizes[written], minlength=len(units)).astype(np.int64))
        numbers = np.stack([np.ones(len(units)), per_unit(unit_of[a_group]), per_unit(unit_of[b_group]), per_unit(unit_of), np.bincount(unit_of[a_group], many, minlength=len(units))], axis=1)
        self._keep(units, numbers, text, text_ends, pair, times, np.cumsum(per_unit(item)))
        return []

    def texts(self, unit: np.ndarray) -> bytes:
        """The groups of consecutive units, joined by semicolons."""
        text, at = self.text, self.text_at
        return b"".join([text[at[u] : at[u + 1]] for u in unit.tolist()])[:-1]

    def told(self, unit: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.numbers, np.int64).reshape(-1, 5)[unit] if len(unit) else np.zeros((0, 5), np.int64)

    def links(self, item: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of units that stand in items: (item, pair, times), by item and pair."""
        if not len(unit):
            return (np.zeros(0, np.int64),) * 3
        both, often = np.unique(item << 32 | unit, return_counts=True)
        at = np.frombuffer(self.at, np.int64)
        item, unit = both >> 32, both & 0xFFFFFFFF
        size = at[unit + 1] - at[unit]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - at[unit], size)
        return summed(np.repeat(item, size), np.frombuffer(self.pairs, np.int64)[place], np.frombuffer(self.times, np.int64)[place] * np.repeat(often, size))


def summed(item: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """times summed up by item and pair, in their order."""
    order = np.lexsort((pair, item))
    item, pair, times = item[order], pair[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (pair[1:] != pair[:-1])])) if len(item) else np.zeros(0, np.int64)
    return item[new], pair[new], np.add.reduceat(times, new) if len(new) else times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, by_piece: str) -> Aligner:
    """This worker's aligner for the two files."""
    if (byte_level, by_piece) not in _ALIGNERS:
        _ALIGNERS[byte_level, by_piece] = Aligner(byte_level, by_piece)
    return _ALIGNERS[byte_level, by_piece]


#: A block: its items (documents, or one chunk or the seams of a long document), its distinct pairs, in how many items
#: each is, and the items' links as (links per item, place of the pair, times). `sha` is null where an item is a part of a document.
_BLOCK = "block long, id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, pairs array<long>, items array<long>, per_item binary, which binary, times binary, sha array<string>"
_OPEN = "prefix_a array<int>, prefix_b array<int>, closed boolean, suffix_a array<int>, suffix_b array<int>"
_CHUNK = f"{_BLOCK}, row long, chunk int, whole boolean, text string, {_OPEN}"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _block(block: int, ids: list, numbers: np.ndarray, links: tuple[np.ndarray, np.ndarray, np.ndarray], sha: list | None = None) -> list[pa.Array]:
    """The columns of _BLOCK; numbers has a row per item."""
    item, pair, times = links
    pairs, which, items = np.unique(pair, return_inverse=True, return_counts=True)
    packed = [np.bincount(item, minlength=len(ids)).astype("<u4"), which.astype("<u4"), times.astype("<u8")]
    if len(pairs) < 1 << 16:
        packed[1] = packed[1].astype("<u2")
    if not len(times) or times.max() < 1 << 16:
        packed[2] = packed[2].astype("<u2")
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, *numbers.T.astype(np.int64), pairs, items)]
    return [pa.array([block], pa.int64()), *lists, *[pa.array([x.tobytes()], pa.binary()) for x in packed], pa.array([sha], pa.list_(pa.string()))]


def _short_blocks(docs: DataFrame, byte_level: str, by_piece: str) -> DataFrame:
    """Blocks of documents (doc_id, text) of one fragment each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = aligner(byte_level, by_piece), TaskContext.get().partitionId() << 33
        for batch in pieces(batches, "text"):
            cut = [own.cut(f" {t}") if t else [] for t in batch.column(1).to_pylist()]
            own.learn({u for units in cut for u in units})
            count, n = np.array([len(units) for units in cut]), len(cut)
            item = np.repeat(np.arange(n), count)
            unit = np.array([own.known[u] for units in cut for u in units], np.int64)
            told = own.told(unit)
            bad = np.bincount(item, 1 - told[:, 0], minlength=n) > 0
            numbers = np.stack([np.bincount(item, told[:, k], minlength=n).astype(np.int64) for k in range(1, 5)], axis=1)
            numbers[bad] = 0
            ends = np.cumsum(count)
            sha = ["" if bad[i] or not count[i] else hashlib.sha256(own.texts(unit[ends[i] - count[i] : ends[i]])).hexdigest() for i in range(n)]
            good = ~bad[item]
            yield pa.RecordBatch.from_arrays(_block(block, batch.column(0).to_pylist(), numbers, own.links(item[good], unit[good]), sha), _names(_BLOCK))
            block += 1

    return docs.mapInArrow(run, _BLOCK)


def chunks(text: str, units: bool = True) -> Iterator[tuple[int, int, str]]:
    """(bytes before the chunk, bytes to its end, characters with whole units at both ends) of a text's chunks."""
    left = at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        if end == len(text) or not units:
            right = keep = end = len(text)
        else:
            ahead = _CUT.search(text, end)
            right = ahead.start() if ahead else len(text)
            before = [m.start() for m in _CUT.finditer(text, max(at, end - NEAR), end)]
            keep = before[-1] if before else at
            if not before or right - end > NEAR:
                keep = end = right
            elif right == end:
                keep = end
        skip = len(text[left:at].encode())
        yield skip, skip + len(text[at:end].encode()), text[left:right]
        left, at = keep, end


_CUTS = "row long, doc_id long, chunk int, skip long, stop long, text string"


def _long_chunks(docs: DataFrame, byte_level: str, by_piece: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, row = aligner(byte_level, by_piece).units, TaskContext.get().partitionId() << 33
        for batch in pieces(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (skip, stop, part) in enumerate(chunks(f" {text}", units)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((row, doc_id, i, skip, stop, part), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], _names(_CUTS))
                row += 1

    return docs.mapInArrow(run, _CUTS)


def _chunk_blocks(cuts: DataFrame, byte_level: str, by_piece: str) -> DataFrame:
    """The fragment of each chunk: its closed groups as a block of one item, and its open ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = aligner(byte_level, by_piece), (1 << 62) + (TaskContext.get().partitionId() << 33)
        for batch in pieces(batches, "text"):
            for row, _, chunk, skip, stop, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units = own.cut(text)
                past = len(text.encode()) - stop
                middle = units[bool(skip) : len(units) - bool(past)]
                edges = sorted(({0} if skip else set()) | ({len(units) - 1} if past else set()))
                own.learn(set(middle))
                unit = np.array([own.known[u] for u in middle], np.int64)
                told = own.told(unit)
                whole, ends = bool((told[:, 0] == 1).all()), []
                for e, (fine, a, a_ends, b, b_ends) in zip(edges, own.tokens([units[e] for e in edges]), strict=True):
                    low, high = (skip if e == 0 else 0), len(units[e].encode()) - (past if e == len(units) - 1 else 0)
                    a_in, b_in = ([k for k, x in enumerate(ends_) if low < x <= high] for ends_ in (a_ends, b_ends))
                    whole &= fine
                    ends.append(fragment([a[k] for k in a_in], [a_ends[k] for k in a_in], [b[k] for k in b_in], [b_ends[k] for k in b_in], chunk, at_start=not low))
                before = [ends.pop(0)] if skip else []
                inside = [Fragment(closed=True, first=chunk)] if middle or not before else []
                parts = before + inside + ends
                found = parts[0]
                for part in parts[1:]:
                    found = found + part
                held = len(before[0].groups) if before else 0
                texts = [group_text(a, b) for _, a, b in found.groups]
                text = ";".join([*texts[:held], *([own.texts(unit).decode()] if middle else []), *texts[held:]])
                links: Counter = Counter()
                for _, a, b in found.groups:
                    add_links(links, a, b)
                _, pair, times = own.links(np.zeros(len(unit), np.int64), unit)
                pair = np.concatenate([pair, np.array(list(links.keys()), np.int64)])
                times = np.concatenate([times, np.array(list(links.values()), np.int64)])
                numbers = told[:, 1:].sum(axis=0) + np.array([sum(len(g[1]) for g in found.groups), sum(len(g[2]) for g in found.groups), len(found.groups), sum(links.values())])
                columns = _block(block, [row], numbers[None], summed(np.zeros(len(pair), np.int64), pair, times))
                block += 1
                more = [(row, pa.int64()), (chunk, pa.int32()), (whole, pa.bool_()), (text, pa.string())]
                more += [(x, pa.list_(pa.int32())) for x in found.prefix] + [(found.closed, pa.bool_())] + [(x, pa.list_(pa.int32())) for x in found.suffix]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x], t) for x, t in more]], _names(_CHUNK))

    return cuts.mapInArrow(run, _CHUNK)


_SEAMS = "array<struct<chunk: int, a: array<int>, b: array<int>>>"
_PART = f"row long, chunk int, {_OPEN}, first int, seams {_SEAMS}"


def composed(parts: DataFrame) -> DataFrame:
    """One fragment for each row: its chunks' fragments composed, FAN at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, chunk, told in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                all_parts = [Fragment((p["prefix_a"], p["prefix_b"]), p["closed"], [(s["chunk"], s["a"], s["b"]) for s in p["seams"]], (p["suffix_a"], p["suffix_b"]), p["first"]) for p in sorted(told, key=lambda p: p["chunk"])]
                whole = all_parts[0]
                for part in all_parts[1:]:
                    whole = whole + part
                seams = [{"chunk": c, "a": a, "b": b} for c, a, b in whole.groups]
                out.append({"row": row, "chunk": chunk, "prefix_a": whole.prefix[0], "prefix_b": whole.prefix[1], "closed": whole.closed, "suffix_a": whole.suffix[0], "suffix_b": whole.suffix[1], "first": whole.first, "seams": seams})
            ints = pa.list_(pa.int32())
            kinds = [pa.int64(), pa.int32(), ints, ints, pa.bool_(), ints, ints, pa.int32(), pa.list_(pa.struct([("chunk", pa.int32()), ("a", ints), ("b", ints)]))]
            names = ["row", "chunk", "prefix_a", "prefix_b", "closed", "suffix_a", "suffix_b", "first", "seams"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in zip(names, kinds, strict=True)], names)

    most = parts.agg(F.max("chunk")).first()[0] or 0
    while most > 0:
        told = F.collect_list(F.struct("chunk", "prefix_a", "prefix_b", "closed", "suffix_a", "suffix_b", "first", "seams"))  # FAN of them
        parts = stored(parts.groupBy("row", F.floor(F.col("chunk") / FAN).cast("int").alias("up")).agg(told.alias("told")).mapInArrow(run, _PART))
        most //= FAN
    return parts


def _seam_blocks(whole: DataFrame) -> DataFrame:
    """A block of one item for the groups that composing has closed, and their texts by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (3 << 61) + (TaskContext.get().partitionId() << 33)
        for batch in batches:
            for row, prefix_a, prefix_b, first, seams in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                groups = [(first, prefix_a, prefix_b)] if prefix_a or prefix_b else []
                groups += [(s["chunk"], s["a"], s["b"]) for s in seams]
                links: Counter = Counter()
                for _, a, b in groups:
                    add_links(links, a, b)
                numbers = np.array([[sum(len(g[1]) for g in groups), sum(len(g[2]) for g in groups), len(groups), sum(links.values())]])
                pair, times = np.array(list(links.keys()), np.int64), np.array(list(links.values()), np.int64)
                columns = _block(block, [row], numbers, summed(np.zeros(len(pair), np.int64), pair, times))
                block += 1
                texts = pa.array([[{"chunk": c, "text": group_text(a, b)} for c, a, b in groups]], pa.list_(pa.struct([("chunk", pa.int32()), ("text", pa.string())])))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([row], pa.int64()), texts], [*_names(_BLOCK), "row", "texts"])

    return whole.select("row", "prefix_a", "prefix_b", "first", "seams").mapInArrow(run, f"{_BLOCK}, row long, texts array<struct<chunk: int, text: string>>")


def _hashes(texts: DataFrame) -> DataFrame:
    """(row, sha): of each row's texts in the order (chunk, part), joined by semicolons; one text at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, digest, begun = None, hashlib.sha256(), False

        def told():
            return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([digest.hexdigest()])], ["row", "sha"])

        for batch in batches:
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != row:
                    if begun:
                        yield told()
                    row, digest, begun = r, hashlib.sha256(), False
                digest.update((f";{text}" if begun else text).encode())
                begun = True
        if begun:
            yield told()

    ordered = texts.where("text <> ''").repartition("row").sortWithinPartitions("row", "chunk", "part").select("row", "text")
    return ordered.mapInArrow(run, "row long, sha string")


_SCORED = "id long, sha string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"


def _scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Per item of the blocks: its numbers, n_best and count_sum. `counts` is (pair, n, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sha, n_a, n_b, n_groups, n_links, per_item, which, times, pairs, table in zip(*(batch.column(i) for i in range(11)), strict=True):
                size, many = len(ids), np.frombuffer(per_item.as_py(), "<u4")
                sums = np.zeros((2, size), np.int64)
                if table.is_valid:
                    own, rows = pairs.values.to_numpy(zero_copy_only=False), table.values
                    pair, n, best = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                    order = np.argsort(pair)
                    if len(order) != len(own) or (pair[order] != own).any():
                        raise ValueError("a block's pairs have no counts")
                    told, raw = which.as_py(), times.as_py()
                    total = int(many.sum())
                    which_, times_ = np.frombuffer(told, f"<u{len(told) // total}"), np.frombuffer(raw, f"<u{len(raw) // total}").astype(np.int64)
                    at = order[which_]
                    filled = np.flatnonzero(many)
                    starts = (np.cumsum(many.astype(np.int64)) - many)[filled]
                    sums[0, filled] = np.add.reduceat(times_ * best[at], starts)
                    sums[1, filled] = np.add.reduceat(times_ * n[at], starts)
                numbers = [x.values for x in (n_a, n_b, n_groups, n_links)]
                yield pa.RecordBatch.from_arrays([ids.values, sha.values if sha.is_valid else pa.nulls(size, pa.string()), *numbers, pa.array(sums[0]), pa.array(sums[1])], _names(_SCORED))

    met = blocks.select("block", F.explode("pairs").alias("pair")).join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("table"))  # a block's pairs
    wanted = ["id", "sha", "n_a", "n_b", "n_groups", "n_links", "per_item", "which", "times", "pairs", "table"]
    return blocks.join(met, "block", "left").select(*wanted).mapInArrow(run, _SCORED)


def align(docs: DataFrame, byte_level: str, by_piece: str) -> DataFrame:
    """Per document: its tokens, groups, links, and what its links' pairs count in the corpus."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.length("text") >= CHUNK
    short = stored(_short_blocks(docs.where(F.coalesce(~long, F.lit(True))), byte_level, by_piece))
    cuts = stored(_long_chunks(docs.where(long), byte_level, by_piece))
    chunked = stored(_chunk_blocks(cuts.repartition("row", "chunk"), byte_level, by_piece))
    bad = stored(chunked.where("NOT whole").select("row").distinct())
    chunked = stored(chunked.join(bad, "row", "left_anti"))
    parts = chunked.select("row", "chunk", *_names(_OPEN), F.col("chunk").alias("first"), F.array().cast(_SEAMS).alias("seams"))
    seams = stored(_seam_blocks(composed(parts)))

    columns = _names(_BLOCK)
    long_blocks = chunked.select("row", *columns).union(seams.select("row", *columns))
    in_long = long_blocks.select("row", F.explode("pairs").alias("pair")).distinct().select("pair", F.lit(1).cast("long").alias("items"))
    in_short = short.select(F.explode(F.arrays_zip("pairs", "items")).alias("x")).select("x.pairs", "x.items").toDF("pair", "items")
    counts = stored(in_short.union(in_long).groupBy("pair").agg(F.sum("items").alias("n")))
    a = F.shiftright("pair", 32).alias("a")
    best = counts.groupBy(a).agg(F.max("n").alias("most"))
    counts = stored(counts.withColumn("a", a).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))

    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    short_rows = _scored(short, counts).select(F.col("id").alias("doc_id"), *numbers, F.col("sha").alias("groups_sha256"))
    sums = _scored(long_blocks.select(*columns), counts).groupBy(F.col("id").alias("row")).agg(*[F.sum(c).alias(c) for c in numbers])
    texts = chunked.select("row", "chunk", F.lit(1).alias("part"), "text").union(seams.select("row", F.posexplode("texts").alias("p", "x")).select("row", "x.chunk", F.lit(0), "x.text"))
    rows = cuts.where("chunk = 0").select("row", "doc_id").join(sums, "row", "left").join(_hashes(texts), "row", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers]
    long_rows = rows.select("doc_id", *zero, F.coalesce("sha", F.lit("")).alias("groups_sha256"))
    return short_rows.union(long_rows)
