"""Token ids of whole texts, by ``tokenizers`` and a vocabulary file.

The vocabulary splits a text into runs of letters, single digits and runs of
other signs, drops white space and merges each piece on its own. So the
pieces of a block are found and hashed in numpy, each distinct piece is
encoded once per Python worker (pieces seen before come from a bounded table),
and the ids are gathered back in text order. Texts that hold a special token
are encoded whole.

Piece borders used here are those that the vocabulary's pattern always has:
ASCII white space, a change between ASCII letters, digits and signs, and
between digits; an apostrophe stays with letters after it, and nothing is cut
beside a non-ASCII byte. A piece with non-ASCII signs goes through the whole
tokenizer, normalization included.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import LOWER, ragged, span_hash

#: Distinct pieces that a worker remembers; then it starts again.
REMEMBER = 1_000_000

_CLASS = np.full(256, 4, np.uint8)
_CLASS[:0x80] = 3
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = 1
_CLASS[0x61:0x7B] = 1


def pieces(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, piece starts, ends) of a block of texts."""
    n = len(raw)
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = _CLASS[raw]
    after = np.zeros(n, np.uint8)
    after[:-1] = raw[1:]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    after[edge[1:]] = 0
    # a letter before a combining sign keeps its case: both compose to one letter
    low = np.where(after < 0x80, LOWER[raw], raw)
    a, b = cls[:-1], cls[1:]
    cut = (a != b) | (a == 2)
    cut &= ((a < 4) & (b < 4)) | (a == 0) | (b == 0)
    cut &= ~((raw[:-1] == 0x27) & (b == 1))
    edge[1:-1] |= cut
    ink = cls != 0
    return low, np.flatnonzero(ink & edge[:-1]), np.flatnonzero(ink & edge[1:]) + 1


class Encoder:
    """Encodes blocks of texts; one per Python worker and vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        byte_level = [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel"]
        plain = spec | {"normalizer": None, "pre_tokenizer": byte_level[0], "added_tokens": []}
        #: The same merges for a piece that is known to need no normalization or splitting.
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.vocab_size = self.whole.get_vocab_size()
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids: list[list[int]] = [[]] * len(texts)
        plain, odd = [], []
        for i, t in enumerate(texts):
            if t.isascii():
                simple = t.isalpha() or t.isdigit() or (t.isprintable() and not any(map(str.isalnum, t)))
            else:
                simple = t.isalpha() and max(t) < "İ"  # Latin letters, each composed already
                if simple:
                    texts[i] = t.lower()
            (plain if simple else odd).append(i)
        for tok, at in ((self.plain, plain), (self.whole, odd)):
            if at:
                for i, e in zip(at, tok.encode_batch_fast([texts[i] for i in at], add_special_tokens=False), strict=True):
                    ids[i] = e.ids
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        start = np.cumsum(size) - size + len(self.flat)
        self.flat = np.concatenate([self.flat, np.array([x for w in ids for x in w], np.uint32)])
        at = np.searchsorted(self.known, hashes)
        self.known, self.start, self.size = (
            np.insert(x, at, y) for x, y in ((self.known, hashes), (self.start, start), (self.size, size)))

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        low, s, e = pieces(raw, offs)
        n = len(offs) - 1
        ids, counts = np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if len(s):
            uniq, first, inv = np.unique(span_hash(low, s, e), return_index=True, return_inverse=True)
            if len(self.known) > REMEMBER:
                self.reset()
            at = np.searchsorted(self.known, uniq)
            new = np.ones(len(uniq), bool)
            inside = at < len(self.known)
            new[inside] = self.known[at[inside]] != uniq[inside]
            if new.any():
                buf = low.tobytes()
                self._learn(uniq[new], [buf[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
                at = np.searchsorted(self.known, uniq)
            size = self.size[at][inv]
            ids = self.flat[ragged(self.start[at][inv], size)]
            upto = np.concatenate([[0], np.cumsum(size)])
            counts = np.diff(upto[np.searchsorted(s, offs)])
        buf = raw.tobytes()
        if any(x in buf for x in self.special):
            out = np.split(ids, np.cumsum(counts)[:-1])
            for i in range(n):
                t = buf[offs[i]:offs[i + 1]]
                if any(x in t for x in self.special):
                    out[i] = np.array(self.whole.encode(t.decode(), add_special_tokens=False).ids, np.uint32)
            ids, counts = np.concatenate(out), np.array([len(x) for x in out], np.int64)
        return ids, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Adds the id ``end`` to each text's ids."""
    return np.insert(ids, np.cumsum(counts), end).astype(np.uint32), counts + 1


def split_long(counts: np.ndarray, size: int):
    """(text, piece number, start, length) of each text's pieces of at most
    ``size`` tokens; all but a text's last have just that."""
    num = np.maximum(1, -(-counts // size))
    text = np.repeat(np.arange(len(counts)), num)
    piece = ragged(np.zeros(len(counts), np.int64), num)
    start = piece * size
    return text, piece, start, np.minimum(counts[text] - start, size)
