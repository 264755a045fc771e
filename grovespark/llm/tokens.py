"""Subword ids of whole texts by a public tokenizer, a slice of texts at a time.

A tokenizer of this kind never joins characters across a single space or line
feed between two other characters. So the ids of a text are those of its words,
and a word (with the space before it) always has the same ids. Words met before
are looked up by hash in a table; new ones are encoded once. Texts with other
white space, or with what may be a special token, are encoded whole.
"""

from __future__ import annotations

import base64

import numpy as np

from grovespark.llm.textops import Slice, Words, mix

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Strings that are one token wherever they stand: fixed values of the vocabulary.
SPECIAL = {"<|endoftext|>": 50256}
#: Slots of a worker's word table; at half of them it starts anew.
TABLE = 1 << 20
_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

_coders: dict[str, "Coder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def coder(path: str) -> "Coder":
    """The coder of this Python process for a vocabulary file of ranks."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _odd(s: Slice) -> np.ndarray:
    """Flags of the bytes that make a text odd: white space other than a single space or line feed between two words."""
    d = s.data
    ws = (d == 0x20) | ((d >= 0x09) & (d <= 0x0D))
    bad = ws & (d != 0x20) & (d != 0x0A) | (d >= 0x1C) & (d <= 0x1F)
    if len(d) > 1:
        bad[1:] |= ws[1:] & ws[:-1]
        a, b = d[:-1], d[1:]
        bad[:-1] |= (a == 0x3C) & (b == 0x7C)  # what special tokens begin with
        bad[:-1] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    if len(d) > 2 and (np.any(d == 0xE2) or np.any(d == 0xE1) or np.any(d == 0xE3)):
        a, b, c = d[:-2], d[1:-1], d[2:]
        bad[:-2] |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE1) & (b == 0x9A) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    some = s.offs[:-1] < s.offs[1:]
    first, last = s.offs[:-1][some], s.offs[1:][some] - 1
    bad[first] |= ws[first]
    bad[last] |= ws[last]
    return bad


class Coder:
    """Ids by the ranks of a byte-level vocabulary; a special token in a text is its one id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.marks = {c: ranks[c.encode()] for c in "\n.,"}
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slots = np.zeros(TABLE, _U), np.zeros(TABLE, np.int32)
        self.flat = np.array([self.marks[c] for c in "\n.,"], np.uint16)  # entries 0, 1 and 2 are the marks
        self.start, self.size = np.arange(3), np.ones(3, np.int64)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.bpe.encode(text.decode("utf-8", "replace"), allowed_special="all"), np.uint16)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 if it has none."""
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), (keys & _U(TABLE - 1)).astype(np.int64)
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.slots[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], (at[on] + 1) & (TABLE - 1)
        return out

    def _add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        entry = len(self.start) + np.arange(len(keys))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint16)])
        left, at = np.arange(len(keys)), (keys & _U(TABLE - 1)).astype(np.int64)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            won = free & (self.keys[at] == keys[left])
            self.slots[at[won]] = entry[left[won]]
            left, at = left[~won], (at[~won] + 1) & (TABLE - 1)

    def _learn(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, bare: np.ndarray, keys: np.ndarray) -> None:
        """Encode new words, those with a space before them and those without, each in one call."""
        for kind, sep in ((False, " "), (True, "\n")):
            own = np.flatnonzero(bare == kind)
            if not len(own):
                continue
            parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(lo[own].tolist(), hi[own].tolist())]
            ids = np.array(self.bpe.encode_ordinary(sep + sep.join(parts)), np.int64)
            first = ids == self.marks["\n"] if kind else self.spaced[ids]
            begin = np.flatnonzero(first)
            if len(begin) != len(own):  # a word's ids can't be told apart: one by one
                each = [np.array(self.bpe.encode_ordinary(p if kind else sep + p), np.int64) for p in parts]
                self._add(keys[own], np.concatenate(each), np.array([len(x) for x in each], np.int64))
                continue
            sizes = np.diff(np.append(begin, len(ids))) - kind
            self._add(keys[own], ids[~first] if kind else ids, sizes)

    def encode(self, s: Slice, w: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one after another (uint16), and ids by text; ``w``, its words if known, is used up."""
        w = w or s.words()
        odd = s.per_text(_odd(s)) > 0
        n = len(w.starts)
        lone = np.zeros(len(s.data) + 1, bool)
        lone[s.offs] = True
        opens = lone[w.starts]  # first of its text
        before = s.data[np.maximum(w.starts - 1, 0)]
        line = ~opens & (before == 10)
        bare = opens | line
        last = s.data[w.ends - 1]
        tail = ((last == 0x2E) | (last == 0x2C)) & (w.ends - w.starts > 1) & _LETTER[s.data[np.maximum(w.ends - 2, 0)]]
        stop = w.ends - tail
        w.ends = stop
        keys = mix(w.hashes() + bare.astype(_U)) | _U(1)
        use = ~np.repeat(odd, w.counts)
        entry = np.full(n, 0, np.int64)
        found = self._find(keys[use])
        if (found < 0).any():
            if len(self.start) > TABLE // 2:
                self._reset()
                found[:] = -1
            new, at = np.unique(keys[use][found < 0], return_index=True)
            at = np.flatnonzero(use)[np.flatnonzero(found < 0)[at]]
            if len(self.start) + len(new) < TABLE * 3 // 4:
                self._learn(s.data, w.starts[at], stop[at], bare[at], new)
                found = self._find(keys[use])
            else:  # more new words in one text than the table holds
                odd[:] = True
                use[:] = False
                found = found[:0]
        entry[use] = found
        # The units of a word: a line feed, the word, a full stop or comma.
        units = use * (1 + line + tail)
        ends = np.cumsum(units)
        unit = np.zeros(int(ends[-1]) if n else 0, np.int64)
        unit[(ends - units)[use & line]] = 0
        unit[(ends - units + line)[use]] = entry[use]
        unit[(ends - 1)[use & tail]] = np.where(last[use & tail] == 0x2E, 1, 2)
        size = self.size[unit]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[unit] - total[:-1], size) + np.arange(total[-1])]
        by_word = np.concatenate([[0], total[ends]]) if n else np.zeros(1, np.int64)
        counts = by_word[w.bounds[1:]] - by_word[w.bounds[:-1]]
        if odd.any():
            cut = np.concatenate([[0], np.cumsum(counts)])
            parts = [self.whole(s.text(i)) if odd[i] else ids[cut[i] : cut[i + 1]] for i in range(s.n)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts
