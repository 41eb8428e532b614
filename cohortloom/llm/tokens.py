"""Token ids of whole texts by public tokenizers, fast on texts with many repeated words.

The `tokenizers` library encodes each distinct chunk and the chunks' ids are
strung together, where the tokenizer's rules allow a cut: byte-level
vocabularies split at a space between two other characters, and between a letter
and a full stop or comma that ends a word, before they merge anything. Texts
with other white space (runs, tabs, leading or trailing) or with the content of
an added token, and all texts of a tokenizer with other rules, are encoded whole.

Chunks are found, hashed (128 bits, by random polynomials) and looked up for
many texts at once in NumPy. A worker remembers some 50 bytes for each chunk
and forgets all when it holds CHUNKS.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

#: Chunks that a Python worker remembers at most.
CHUNKS = 1_600_000
#: Characters that are cut into chunks at once.
GULP = 400_000
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
#: White space other than the space and the line break.
_OTHER = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
#: What comes before a chunk: a space, the text's start, a line break, or the word that it ends.
SPACE, START, BREAK, WORD = range(4)
_U64 = np.uint64


def _odd(text: str) -> bool:
    """Whether the text has white space that isn't a single space or line break between other characters."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or _OTHER.search(text) is not None


def _narrow(text: str) -> bool:
    """Whether all characters are Latin-1: none combines with another, and lower case is a matter of each alone."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Table:
    """Numbers of 128-bit keys, by open addressing; lookups and insertions are of whole arrays."""

    def __init__(self, capacity: int):
        bits = max(10, (2 * capacity).bit_length())
        self.slots, self.mask = np.full(1 << bits, -1, np.int32), _U64((1 << bits) - 1)
        self.keys = np.zeros((2, capacity), _U64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each key (columns of h), or -1."""
        out = np.full(h.shape[1], -1, np.int64)
        at, slot = np.arange(h.shape[1]), h[0] & self.mask
        while len(at):
            found = self.slots[slot]
            some = found >= 0
            same = some & (self.keys[0][found] == h[0][at]) & (self.keys[1][found] == h[1][at])
            out[at[same]] = found[same]
            on = some & ~same
            at, slot = at[on], (slot[on] + _U64(1)) & self.mask
        return out

    def add(self, h: np.ndarray, first: int) -> None:
        """Numbers distinct new keys from first on."""
        number = np.arange(first, first + h.shape[1], dtype=np.int32)
        self.keys[:, first : first + h.shape[1]] = h
        slot = h[0] & self.mask
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]  # of several that want one slot the last gets it
            on = self.slots[slot] != number
            number, slot = number[on], (slot[on] + _U64(1)) & self.mask


class Encoder:
    """Encodes texts with a tokenizer file; add_special_tokens is off."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [rules["normalizer"]] if rules["normalizer"] else [])]
        cuts = [x["type"] for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [rules["pre_tokenizer"]])]
        self.lowers = steps == ["NFC", "Replace", "Lowercase"]
        self.cuttable = (self.lowers and cuts == ["Split", "ByteLevel"]) or (not steps and cuts == ["ByteLevel"])
        # what the tokenizer takes out of a text before all other steps, or after the normalizer
        self.added = [x["content"] for x in rules["added_tokens"]]
        self.added_lower = [x.lower() for x in self.added]
        # the same vocabulary without the steps that change nothing: for lower-case Latin-1 text, and for letters alone
        self.plain, self.letters = self.tokenizer, self.tokenizer
        if self.lowers:
            self.plain, self.letters = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = self.tokenizer.pre_tokenizer
            self.letters.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        turn = np.random.default_rng()
        self.of_byte = turn.integers(0, 1 << 63, (2, 256), dtype=_U64) * _U64(2) + _U64(1)
        self.of_kind = turn.integers(0, 1 << 63, (2, 4), dtype=_U64)
        # a base of 3 modulo 8 has an inverse, and powers that agree in few low bits
        self.base = [int(b) * 8 + 3 for b in turn.integers(1 << 40, 1 << 60, 2)]
        self.powers = np.ones((2, 1), _U64)
        self.inverse = np.ones((2, 1), _U64)
        self._clear()

    def _whole(self, text: str) -> bool:
        """Whether the text can't be cut into chunks."""
        if not self.cuttable or _odd(text) or any(x in text for x in self.added):
            return True
        if not self.lowers:
            return False
        low = text.lower()
        return any(x in low for x in self.added_lower)

    def _clear(self, room: int = 0) -> None:
        """Forgets all; room: chunks that one text, which may be of any length, needs at once."""
        self.table = _Table(max(CHUNKS, 2 * room) + 1)
        self.ids = np.zeros(1 << 20, "<u4")
        self.ends = np.zeros(max(CHUNKS, 2 * room) + 2, np.int64)
        self.ends[1], self.n = 1, 1  # number 0 stands for whatever id ends a text

    def _reach(self, n: int) -> None:
        """Powers of the bases and of their inverses up to n."""
        if self.powers.shape[1] <= n:
            size = max(n + 1, 2 * self.powers.shape[1])
            for k, b in enumerate(self.base):
                for name, value in (("powers", b), ("inverse", pow(b, -1, 1 << 64))):
                    row = np.full(size, value, _U64)
                    row[0] = 1
                    if k == 0:
                        setattr(self, name, np.empty((2, size), _U64))
                    getattr(self, name)[k] = np.cumprod(row)

    def _hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
        self._reach(len(data))
        h = np.empty((2, len(start)), _U64)
        for k in range(2):
            sums = np.empty(len(data) + 1, _U64)
            sums[0] = 0
            np.cumsum(self.of_byte[k][data] * self.powers[k, : len(data)], out=sums[1:])
            x = (sums[end] - sums[start]) * self.inverse[k][start] + self.of_kind[k][kind]
            h[k] = x ^ x >> _U64(31)
        return h

    def _encode(self, chunks: list[bytes], kinds: list[int]) -> list[list[int]]:
        groups: dict[str, tuple[list, list]] = {"tokenizer": ([], []), "plain": ([], []), "letters": ([], [])}
        for k, (raw, kind) in enumerate(zip(chunks, kinds)):
            c, name = raw.decode(), "tokenizer"
            if self.lowers:  # white space is dropped anyway
                if c == c.lower() and _narrow(c):
                    name = "letters" if c.isalpha() else "plain"
            elif kind == SPACE:
                c = " " + c
            elif kind == BREAK:
                c = "\n" + c
            groups[name][0].append(k)
            groups[name][1].append(c)
        coded: list[list[int]] = [[]] * len(chunks)
        for name, (at, texts) in groups.items():
            for k, e in zip(at, getattr(self, name).encode_batch_fast(texts, add_special_tokens=False)):
                coded[k] = e.ids
        return coded

    def __call__(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids (little-endian uint32) of each text, and end after them."""
        tail = np.zeros(0, "<u4") if end is None else np.array([end], "<u4")
        out: list[np.ndarray] = [tail] * len(texts)
        odd = [k for k, t in enumerate(texts) if t and self._whole(t)]
        for k in odd:
            out[k] = np.append(np.array(self.tokenizer.encode_batch_fast([texts[k]], add_special_tokens=False)[0].ids, "<u4"), tail)
        apart = set(odd)
        even = [k for k, t in enumerate(texts) if t and k not in apart]
        first = 0
        while first < len(even):  # whole texts, some hundred thousand characters at a time
            last, size = first, 0
            while last < len(even) and (last == first or size + len(texts[even[last]]) <= GULP):
                size += len(texts[even[last]])
                last += 1
            for k, ids in zip(even[first:last], self._even([texts[k] for k in even[first:last]], end)):
                out[k] = ids
            first = last
        return out

    def _chunks(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, kind of each chunk; how many of them are before each text's end) of texts joined by line breaks."""
        gaps = np.flatnonzero((data == 32) | (data == 10))
        start, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
        kind = np.where(np.concatenate(([10], data[gaps])) == 32, SPACE, BREAK)
        begins = np.searchsorted(start, np.cumsum(lengths + 1) - lengths - 1)
        kind[begins] = START
        if self.lowers:
            kind[:] = SPACE
        # a full stop or comma after a letter becomes a chunk of its own
        last, before = data[end - 1], data[np.maximum(end - 2, 0)] | 32
        cut = ((last == 46) | (last == 44)) & (end - start > 1) & (before >= 97) & (before <= 122)
        word = np.repeat(np.arange(len(start)), 1 + cut)
        mark = np.zeros(len(word), bool)
        mark[1:] = word[1:] == word[:-1]
        stops = np.concatenate((begins[1:], [len(start)])) + np.concatenate(([0], np.cumsum(cut)))[np.concatenate((begins[1:], [len(start)]))]
        kinds = np.where(mark, SPACE if self.lowers else WORD, kind[word])
        return np.where(mark, end[word] - 1, start[word]), np.where(mark, end[word], end[word] - cut[word]), kinds, stops

    def _even(self, texts: list[str], end: int | None) -> list[np.ndarray]:
        if self.lowers:
            texts = [t.lower() if _narrow(t) else t for t in texts]
        raw = [t.encode() for t in texts]
        joined = b"\n".join(raw)
        data = np.frombuffer(joined, np.uint8)
        start, stop, kind, ends = self._chunks(data, np.fromiter(map(len, raw), np.int64, len(raw)))
        if self.n + len(start) >= self.table.keys.shape[1]:
            self._clear(len(start))
        h = self._hashes(data, start, stop, kind)
        number = self.table.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            _, first, where = np.unique(h[0][new], return_index=True, return_inverse=True)
            at = new[first]
            if (h[1][at][where] != h[1][new]).any():  # two chunks with one half of a key
                return [np.append(np.array(e.ids, "<u4"), [] if end is None else [end]).astype("<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            coded = self._encode([joined[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist())], kind[at].tolist())
            number[new] = self.n + where
            self._remember(h[:, at], coded)
        if end is not None:
            number = np.insert(number, ends, 0)
            ends = ends + np.arange(1, len(ends) + 1)
        starts = self.ends[number]
        sizes = self.ends[number + 1] - starts
        total = np.cumsum(sizes)
        ids = self.ids[np.repeat(starts - total + sizes, sizes) + np.arange(total[-1])]
        stops = total[ends - 1]
        if end is not None:
            ids[stops - 1] = end
        return np.split(ids, stops[:-1])

    def _remember(self, h: np.ndarray, coded: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        first, n, more = int(self.ends[self.n]), self.n, int(sizes.sum())
        while first + more > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[first : first + more] = np.fromiter(chain.from_iterable(coded), np.uint32, more)
        self.ends[n + 1 : n + 1 + len(sizes)] = first + np.cumsum(sizes)
        self.table.add(h, n)
        self.n = n + len(sizes)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for the file: its memory serves all tasks that the worker runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
