"""Token ids of whole texts by a public tokenizer, encoding each distinct piece of text once per process.

The tokenizer lower-cases, drops white space and cuts words at changes between
letters, digits and other characters.  So a text's ids are those of its words
one after another, and a word may be cut further where a letter a-z meets one
of the marks in CUTS.  Capitals are folded beforehand unless a byte beyond
ASCII follows, as it may be a combining accent.  Texts that hold ``<|`` (the
start of a special token) are encoded directly.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from rankfield.llm.core import LOWER, WHITE, ranges, span_hashes

CUTS = np.zeros(256, bool)
CUTS[list(b'.,!?;:%$#*&"()')] = True
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
#: A process forgets its pieces when it has this many.
MOST_PIECES = 1_300_000
SLOT_BITS = 21
SLOT_MASK = np.uint64((1 << SLOT_BITS) - 1)
SLOT_SHIFTS = (np.uint64(0), np.uint64(21), np.uint64(42))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes; start and end of each piece in them; index of each text's first piece."""
    low = LOWER[buf]
    beyond = np.flatnonzero(buf[1:] > 127) if len(buf) > 1 else np.zeros(0, np.int64)
    low[beyond] = buf[beyond]
    word = ~WHITE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    edge[1:-1] |= LETTER[low[:-1]] & CUTS[low[1:]]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return low, start, end, np.searchsorted(start, off)


class PieceEncoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)  # a piece's hash stands in one of three slots
        self.values = np.zeros(1 << SLOT_BITS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 15, np.int64)  # where a piece's ids start
        self.known = self.used = 0

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pieces, many in one text; a token's offset tells its piece."""
        flat, length = [], []
        for a in range(0, len(pieces), 4096):
            part = pieces[a : a + 4096]
            lines = [part[i : i + 256] for i in range(0, len(part), 256)]
            for line, e in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False)):
                begins = np.cumsum([0, *[len(x) + 1 for x in line]])
                of = np.searchsorted(begins, np.array([x for x, _ in e.offsets], np.int64), "right") - 1
                flat.append(np.array(e.ids, np.uint32))
                length.append(np.bincount(of, minlength=len(line)))
        ids, size = np.concatenate(flat), np.concatenate(length)
        n, base = self.known, self.used
        while len(self.ids) < base + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.at) < n + len(pieces) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[base : base + len(ids)] = ids
        self.at[n : n + len(pieces) + 1] = base + np.concatenate([[0], np.cumsum(size)])
        self.used += len(ids)
        self.known += len(pieces)

    def find(self, h: np.ndarray) -> np.ndarray:
        """A piece's number, or -1."""
        slot = (h & SLOT_MASK).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.values[slot], -1)
        for shift in SLOT_SHIFTS[1:]:
            left = np.flatnonzero(out < 0)
            slot = ((h[left] >> shift) & SLOT_MASK).astype(np.int64)
            out[left] = np.where(self.keys[slot] == h[left], self.values[slot], -1)
        return out

    def enter(self, h: np.ndarray, number: np.ndarray) -> None:
        for shift in SLOT_SHIFTS:
            slot = ((h >> shift) & SLOT_MASK).astype(np.int64)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            self.values[slot[free]] = number[free]
            kept = self.keys[slot] == h
            self.values[slot[kept]] = number[kept]
            h, number = h[~kept], number[~kept]
        slot = (h & SLOT_MASK).astype(np.int64)  # all slots taken: the last comer stays, the other is learned again when met
        self.keys[slot] = h
        self.values[slot] = number
        kept = self.keys[slot] == h
        self.values[slot[kept]] = number[kept]

    def numbers(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each piece; learns those not met before."""
        if self.known > MOST_PIECES:
            self.clear()
        h = span_hashes(low, start, end)
        out = self.find(h)
        left = np.flatnonzero(out < 0)
        if len(left):
            kinds, seen, which = np.unique(h[left], return_index=True, return_inverse=True)
            raw, n = low.tobytes(), self.known
            self.learn([raw[x:y].decode("utf-8") for x, y in zip(start[left[seen]].tolist(), end[left[seen]].tolist())])
            number = np.arange(n, n + len(kinds), dtype=np.int32)
            self.enter(kinds, number)
            out[left] = number[which]
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and where each text's ids start, with the end."""
        if bytes(buf).find(b"<|") >= 0:
            raw = buf.tobytes()
            each = self.direct([raw[a:b].decode("utf-8") for a, b in zip(off[:-1], off[1:])])
            return np.concatenate([*each, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        low, start, end, first = cut_pieces(buf, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        number = self.numbers(low, start, end)
        at = self.at[number]
        length = self.at[number + 1] - at
        total = np.concatenate([[0], np.cumsum(length)])
        return self.ids[ranges(at, length)], total[first]


def id_type(vocabulary: int) -> type:
    """Of ids in tables; id vocabulary, one beyond the last, has room too."""
    return np.uint16 if vocabulary < 1 << 16 else np.uint32


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
