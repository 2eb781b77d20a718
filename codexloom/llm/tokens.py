"""Token ids of whole texts, vectorised: each different piece of text is encoded once per worker.

The vocabulary drops white space and lower-cases, its pre-tokenizer never joins a letter to punctuation other than an
apostrophe, and no token spans two of its matches. So a text's ids are those of its pieces end to end, where pieces are
words cut between ASCII letters or digits and ASCII punctuation. Steps in which the string of a special token occurs
(in any case) are cut at white space only. Pieces are interned by a 64-bit hash, and every hit is compared byte by byte with
the known piece; the table of known pieces is emptied when it is full, so memory stays bounded. Ids take two bytes each, or
four where the vocabulary has more than 65,536.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import Words, flat, same_bytes, steps

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: 1: ASCII letters and digits, 2: ASCII punctuation without the apostrophe, 0: all else.
_KIND = np.zeros(256, np.uint8)
for _c in range(33, 127):
    _KIND[_c] = 1 if chr(_c).isalnum() else 2
_KIND[39] = 0
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_LOADED: dict[str, "WordIds"] = {}


class WordIds:
    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        added = self.tokenizer.get_added_tokens_decoder()
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max([*vocabulary.values(), *added]) + 1, bool)
        self.kind = np.dtype("<u2" if len(self.ending) <= 1 << 16 else "<u4")
        self.ending[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content.lower().encode() for t in added.values()]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)
        # Of each slot: its ids and its bytes.
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        self.begin, self.length, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> Words:
        folded = _FOLD[raw]
        plain = folded.tobytes()
        if any(s in plain for s in self.special):
            found = Words(raw, offsets)
            found.split = False
            return found
        kind = _KIND[folded]
        found = Words(folded, offsets, kind[1:] + kind[:-1] == 3 if len(kind) else None)
        found.split = True
        return found

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), self.kind, int(size.sum())), size

    def _add(self, words: Words, sample: np.ndarray) -> np.ndarray:
        """Encode words, and keep them; their slots."""
        s, e = words.starts[sample], words.ends[sample]
        length = e - s + 1
        joined = np.append(words.raw, np.uint8(10))[np.minimum(np.repeat(s - np.cumsum(length) + length, length) + np.arange(length.sum()), len(words.raw))]
        joined[np.cumsum(length) - 1] = 10
        texts = joined.tobytes().decode("utf-8").split("\n")[:-1]
        # A piece of Latin letters is one match of the pre-tokenizer, so in a text of many of them the ids that end a word
        # show where each piece ends; that costs half of encoding each by itself.
        plain = np.fromiter((_LATIN(x) is not None for x in texts), bool, len(texts)) & words.split
        size, parts = np.zeros(len(texts), np.int64), [self.ids[:0]] * 2
        letters = [x for x, p in zip(texts, plain, strict=True) if p]
        parts[0], _ = self._ids([" ".join(letters[i : i + 200]) for i in range(0, len(letters), 200)])
        ends = np.flatnonzero(self.ending[parts[0]])
        if len(ends) != len(letters):
            raise ValueError("the vocabulary does not mark word ends")
        size[plain] = np.diff(ends, prepend=-1)
        parts[1], size[~plain] = self._ids([x for x, p in zip(texts, plain, strict=True) if not p])
        order = np.append(np.flatnonzero(plain), np.flatnonzero(~plain))
        start = np.empty(len(order), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        slot = len(self.first) + np.arange(len(texts))
        self.first, self.size = np.append(self.first, len(self.ids) + start), np.append(self.size, size)
        self.begin, self.length = np.append(self.begin, len(self.text) + np.cumsum(length) - length), np.append(self.length, length - 1)
        self.ids, self.text = np.concatenate((self.ids, *parts)), np.append(self.text, joined)
        return slot

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each document's first place in them (and the end)."""
        n = len(words.first) - 1
        if not len(words.hashes):
            return self.ids[:0], np.zeros(n + 1, np.int64)
        order = np.argsort(words.hashes)
        ordered = words.hashes[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        keys, sample = ordered[new], order[new]
        at = np.searchsorted(self.keys, keys)
        unknown = self.keys[np.minimum(at, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), bool)
        if unknown.any():
            if len(self.keys) and len(self.keys) + unknown.sum() > self.most:
                self.clear()
                unknown[:] = True
                at = np.zeros(len(keys), np.int64)
            slots = self._add(words, sample[unknown])
            self.keys, self.slot = np.insert(self.keys, at[unknown], keys[unknown]), np.insert(self.slot, at[unknown], slots)
            at = np.searchsorted(self.keys, keys)
        slot = np.empty(len(order), np.int64)
        slot[order] = self.slot[at][np.cumsum(new) - 1]
        size = words.ends - words.starts
        other = np.flatnonzero((size != self.length[slot]) | ~same_bytes(words.raw, words.starts, self.text, self.begin[slot], np.minimum(size, self.length[slot])))
        if len(other):  # words that only share a hash with a known one
            slot[other] = self._add(words, other)
        size = self.size[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.first[slot] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[words.first]


def encoder(path: str) -> WordIds:
    """One per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def encoded(batch: pa.RecordBatch, path: str, text: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    """Each row's place and ids."""
    known = encoder(path)
    raw, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    for a, b in steps(offsets):
        ids, first = known.encode(known.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1]))
        for i in range(b - a):
            yield a + i, ids[first[i] : first[i + 1]]
