"""Token ids of whole texts by a public tokenizer file, with a word cache that a Python worker keeps between tasks."""

from __future__ import annotations

import os
import re

import numpy as np

from .common import kept

MOST_CACHED = 700_000  # words that a worker keeps at most; then it starts afresh

_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: What the tokenizer's own white space and Python's str.split() treat differently.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE files write each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """ids(text): as Tokenizer.encode(text, add_special_tokens=False), as little-endian bytes of `width` each.

    Word by word, since the tokenizer splits at white space before all else; a word of letters and at most one
    stop goes to the model at once, any other through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.letters = byte_letters()
        self.words = _Words(self._word)
        self.stems: dict[str, bytes] = {}
        probe = ["Thing", "überaß", "À", "on", "zzxq"]
        self.fast = all(self._model(w.lower()) == self._encode(w) for w in probe) and all(self._encode(f"on{c}") == self._encode("on") + self._encode(c) for c in ".,")
        # white space must part words whatever stands beside it
        self.split = self._encode("a b\n\tc,d é") == b"".join(map(self._encode, ["a", "b", "c,d", "é"]))

    def _encode(self, text: str) -> bytes:
        return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        if len(ids) > 8:
            return np.array(ids, np.int64).astype(self.kind).tobytes()
        return b"".join([i.to_bytes(self.width, "little") for i in ids])  # sooner for a few

    def _model(self, stem: str) -> bytes:
        written = stem if stem.isascii() else "".join(self.letters[b] for b in stem.encode())
        return self._bytes([t.id for t in self.whole.model.tokenize(written)])

    def _word(self, word: str) -> bytes:
        m = _PLAIN.fullmatch(word) if self.fast else None
        if m:
            stem = m[1].lower()
            out = self.stems.get(stem)
            if out is None:
                out = self.stems[stem] = self._model(stem)
            return out + self.words[m[2]] if m[2] else out
        return self._encode(word)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.split or _ODD_SPACE.search(text):
            return self._encode(text)
        words = self.words
        if len(words) + len(self.stems) > MOST_CACHED:
            words.clear()
            self.stems.clear()
        return b"".join(map(words.__getitem__, text.split()))


class _Words(dict):
    """word -> ids; what isn't there yet is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        out = self[word] = self.encode(word)
        return out


def encoder(path: str) -> Encoder:
    """This worker's encoder for the file, kept until the worker keeps something else."""
    return kept(("encoder", path), lambda: Encoder(path))
