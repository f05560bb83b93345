"""Byte-level BPE ids of many texts, by the tokenizers library, at the speed of array look-ups.

BPE never merges across pre-tokens. A single space or line feed between two characters that are not white space always
begins a new pre-token, and so does an ASCII mark after a letter or digit. So texts are cut there, the library encodes each distinct chunk once, and the chunks of a
batch are looked up together: a table in numpy arrays maps a chunk's 64-bit hash to its ids. The table's size is bounded.
Texts with any other white space or with the string of an added token (as ``<|endoftext|>``) go to the library whole. The ids are those that the library gives for the whole text
(two chunks of equal hash would be mistaken for each other; among 2^21 chunks that has a probability of 1e-7).
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Chunks that a worker keeps: 2^22 slots of 16 bytes and their ids, some 90 MB. The first are kept, as frequent ones come
#: early; where most of a batch is unknown (another language, say), the table begins anew.
KEPT = 2_000_000
#: Texts that the library must see whole.
ODD = r"[\t\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]|[ \n][ \n]|^[ \n]|[ \n]$|^$"
#: A chunk follows a space, a line feed, or a letter or digit; the same bytes have other ids in each case.
SPACE, FEED, INNER = 0, 1, 2
KINDS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
MARK = np.array([c < 128 and chr(c).isprintable() and not chr(c).isalnum() and c != 32 for c in range(256)])
WORD = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
#: Of eight bytes, the first so many.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Odd factors that mix a chunk's eight-byte words; longer chunks are hashed by the library.
MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)]


def _keys(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk of bytes."""
    import xxhash

    padded = np.concatenate([raw, np.zeros(8 * len(MIX), np.uint8)])
    words = np.ndarray((len(raw) + 8 * (len(MIX) - 1) + 1,), "<u8", padded, 0, (1,))  # eight bytes from any place
    keys = size.astype(np.uint64)
    for i, factor in enumerate(MIX):
        own = slice(None) if i == 0 else np.flatnonzero(size > 8 * i)
        part = keys[own] + (words[begin[own] + 8 * i] & MASKS[np.minimum(size[own] - 8 * i, 8)])
        part *= factor
        keys[own] = part ^ (part >> np.uint64(31))
    for i in np.flatnonzero(size > 8 * len(MIX)):
        keys[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : begin[i] + size[i]].tobytes())
    keys *= MIX[1]
    return keys ^ (keys >> np.uint64(29))


class Table:
    """Hashes to ids, open addressing in arrays."""

    def __init__(self, slots: int = 1 << 16) -> None:
        self.mask, self.used = slots - 1, 0
        self.keys, self.start, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.filled, self.moved = np.zeros(1 << 18, "<u2"), 0, False

    def copy(self) -> Table:
        out = Table(2)
        out.__dict__.update(self.__dict__ | {"keys": self.keys.copy(), "start": self.start.copy(), "size": self.size.copy(), "pool": self.pool[: self.filled].copy()})
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if there is none."""
        slot = (keys >> np.uint64(20)).astype(np.int64) & self.mask
        held = self.keys[slot]
        out = np.where(held == keys, slot, -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = slot[hit]
            on = ~hit & (held != 0)
            left, slot = left[on], slot[on]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct new keys with their ids, one after another."""
        if 2 * (self.used + len(keys)) > self.mask:
            old = self.keys != 0
            bigger = Table(1 << int(2 * (self.used + len(keys))).bit_length())
            bigger.pool, bigger.filled = self.pool, self.filled
            bigger._place(self.keys[old], self.start[old], self.size[old])
            self.__dict__ = bigger.__dict__
            self.moved = True
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(self.filled + 2 * len(ids), "<u2")])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self._place(keys, (self.filled + np.cumsum(sizes) - sizes).astype(np.int32), sizes.astype(np.int32))
        self.filled += len(ids)

    def _place(self, keys: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.used += len(keys)
        slot = (keys >> np.uint64(20)).astype(np.int64) & self.mask
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[slot[own]], self.start[slot[own]], self.size[slot[own]] = keys[own], start[own], size[own]
            left = np.ones(len(keys), bool)
            left[own] = False
            keys, start, size, slot = keys[left], start[left], size[left], (slot[left] + 1) & self.mask


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        if max(self.lib.get_vocab(with_added_tokens=True).values()) > 0xFFFF:
            raise ValueError("ids are held in 16 bits; the vocabulary has more")
        # A text with an added token's string goes to the library whole, as one id may stand across chunks there.
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD, *(re.sub(r"([^\w\s])", r"\\\1", t) for t in added)])
        self.feed = self._ids(["\n"])[0][0]
        self.table = Table()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u2") for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the chunks, their ids in that order, and how many each has; a chunk's space or line feed counts
        with it. Many go at one call, as line feeds between chunks are ids of their own that no chunk holds."""
        ids, sizes, order = [], np.zeros(len(chunks), np.int64), np.argsort(kinds, kind="stable")
        for kind in (SPACE, FEED, INNER):
            own, join = order[kinds[order] == kind], "\n " if kind == SPACE else "\n"
            groups = [own[i : i + 256] for i in range(0, len(own), 256)]
            for group, found in zip(groups, self._ids([join + join.join([chunks[i] for i in g]) + "\n" for g in groups]), strict=True):
                cuts = np.flatnonzero(found == self.feed)
                sizes[group] = np.diff(cuts) - (kind != FEED)
                ids.append(found[:-1] if kind == FEED else np.delete(found, cuts))
        return order, np.concatenate(ids), sizes[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (null: empty), and how many each has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = texts if not odd.any() else texts.filter(pa.array(~odd))
        ids, n = self._plain(plain) if len(plain) else (np.empty(0, "<u2"), np.empty(0, np.int64))
        if not odd.any():
            return ids, n
        lens, pieces, ends = np.zeros(len(odd), np.int64), [], np.concatenate([[0], np.cumsum(n)])
        whole, k, last = iter(texts.filter(pa.array(odd)).to_pylist()), 0, 0
        for i in np.flatnonzero(odd):
            k += i - last  # the plain texts before it
            pieces += [ids[ends[k - (i - last)] : ends[k]], self._ids([next(whole)])[0]]
            lens[i], last = len(pieces[-1]), i + 1
        lens[~odd] = n
        return np.concatenate([*pieces, ids[ends[k] :]]), lens

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        # Chunks begin with a text, after a separator or with a mark; they end before those or with a text.
        gaps, mark = np.flatnonzero((raw == 32) | (raw == 10)), np.zeros(len(raw), bool)
        mark[1:] = MARK[raw[1:]] & WORD[raw[:-1]]
        mark[bounds[:-1]] = False
        marks = np.flatnonzero(mark)
        begin = np.sort(np.concatenate([gaps + 1, bounds[:-1], marks]))
        end = np.sort(np.concatenate([gaps, bounds[1:], marks]))
        first = np.searchsorted(begin, bounds[:-1])
        before = raw[np.maximum(begin - 1, 0)]
        kinds = np.where(before == 32, SPACE, np.where(before == 10, FEED, INNER))
        kinds[first] = FEED
        keys = _keys(raw, begin, end - begin) ^ KINDS[kinds]
        keys |= np.uint64(1 << 63)  # 0 marks a free slot
        slot = self.table.find(keys)
        table = self.table
        if len(unknown := np.flatnonzero(slot < 0)):
            new, at = np.unique(keys[unknown], return_index=True)
            at = unknown[at]
            view = memoryview(raw)
            chunks = [str(view[a:b], "utf-8") for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            order, ids, sizes = self._learn(chunks, kinds[at])
            if table.used + len(new) > KEPT:
                if len(unknown) > len(keys) / 2:
                    self.table = Table()
                table = table.copy()  # for this batch alone
            table.moved = False
            table.add(new[order], ids, sizes)
            if table.moved:  # to more slots
                slot = table.find(keys)
            else:
                slot[unknown] = table.find(keys[unknown])
        start, size = table.start[slot].astype(np.int64), table.size[slot].astype(np.int64)
        start[first] += 1  # no line feed stands before a text
        size[first] -= 1
        done = np.cumsum(size)
        out = table.pool[np.repeat(start - (done - size), size) + np.arange(done[-1])]
        return out, np.diff(np.concatenate([[0], done])[np.append(first, len(begin))])


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20):
    """The batch in pieces of about ``most`` bytes of text, so that memory does not follow the batch."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def ends(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With ``END`` after each text."""
    return np.insert(ids, np.cumsum(lens), END), lens + 1
