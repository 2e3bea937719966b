"""A fixed public vocabulary of pieces, tries of words, and the pieces that end at each node of a trie."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

MARK = "▁"  # stands at the start of a word
BASE = np.uint64(0x9E3779B97F4A7C15)  # of the polynomial hashes, modulo 2**64
MIX = np.uint64(0xD6E8FEB86659FD93)
SLOTS = 19  # bits of a slot's number
LONG = 256  # characters; longer words are not put in a trie
BANDS = (24, 64, LONG)  # words of like length share a trie
BLOCK = 16_384  # words of a trie


class Level(NamedTuple):
    """The nodes of one depth: they are numbered from `first` on, each with its last character and its parent. `edges` has,
    for each size of piece, the places in the level that such a piece ends at, the nodes it starts from, and the pieces."""

    first: int
    codes: np.ndarray
    parent: np.ndarray
    edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def lacking(self) -> np.ndarray:
        """Places whose last character is no piece by itself."""
        return np.setdiff1d(np.arange(len(self.codes)), self.edges[0][0], assume_unique=True)


class Vocabulary:
    """The ordinary pieces of a sentencepiece model file, in the order of their ids, which is the order of frequency."""

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces: list[str] = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.place = {t: i for i, t in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        #: for each last letter the sizes of the pieces that end in it
        sizes: dict[str, set[int]] = {}
        for t in self.pieces:
            sizes.setdefault(t[-1], set()).add(len(t))
        self.sizes = {c: sorted(s) for c, s in sizes.items()}
        self._tables()

    def _tables(self) -> None:
        """Two tables of slots by hash (the second for pieces whose slot in the first is taken), and the sizes of the pieces
        that end in two characters, as bits."""
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]), dtype="u8")
        hashes = []
        for t in self.pieces:
            h = 0
            for c in map(ord, t):
                h = (h * int(BASE) + c + 1) & (2**64 - 1)
            hashes.append(h)
        self.hashes = np.array([*hashes, 0], "u8")  # the last one is that of no piece
        slot = self._slot(self.hashes[:-1])
        self.first, self.second = np.full(1 << SLOTS, -1, "i4"), {}
        for k, at in enumerate(slot.tolist()):
            if self.first[at] < 0:
                self.first[at] = k
            else:
                self.second[hashes[k]] = k
        self.late = np.array(sorted(self.second), "u8")
        self.late_pieces = np.array([self.second[h] for h in self.late.tolist()], "i4")
        self.ends = np.full(1 << 16, 2, "u8")  # one character may always be a piece
        for t in self.pieces:
            if len(t) > 1:
                self.ends[self._two(np.uint32(ord(t[-2])), np.uint32(ord(t[-1])))] |= np.uint64(1 << min(len(t), 63))

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * MIX) >> np.uint64(64 - SLOTS)).astype(np.int64)

    @staticmethod
    def _two(before, last):
        return (before * np.uint32(40503) + last) & np.uint32(0xFFFF)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        k = self.first[self._slot(hashes)]
        off = np.nonzero(self.hashes[k] != hashes)[0]
        if len(off):
            k[off] = -1
            if len(self.late):
                at = np.minimum(np.searchsorted(self.late, hashes[off]), len(self.late) - 1)
                there = self.late[at] == hashes[off]
                k[off[there]] = self.late_pieces[at[there]]
        return k

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(from, to, piece) of all pieces in the word, by their end."""
        out, place, sizes = [], self.place, self.sizes
        for end in range(1, len(word) + 1):
            for size in sizes.get(word[end - 1], ()):
                if size > end:
                    break
                k = place.get(word[end - size : end])
                if k is not None:
                    out.append((end - size, end, k))
        return out

    def levels(self, words: list[str], ends: np.ndarray) -> Iterator[Level]:
        """The trie of sorted distinct words, level by level; node 0 is the root. ends[i] becomes the node of word i."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        depth = int(size.max(initial=0))
        letters = np.ascontiguousarray(np.array(words, dtype=f"<U{max(depth, 1)}").view("<u4").reshape(len(words), -1).T)
        rows = np.arange(len(words))
        ends[:] = 0
        same = np.ones(max(len(words) - 1, 0), bool)  # whether a row has the prefix of the row before it
        hashes: deque = deque([np.zeros(len(words), "u8")], self.longest + 1)
        nodes: deque = deque([np.zeros(len(words), np.int64)], self.longest + 1)
        before, first = None, 1
        for d in range(depth):
            live = size > d
            if not live.all():  # words that ended go; what is left of neighbours stays in order
                both = live[1:] & live[:-1]
                keep = np.nonzero(live)[0]
                linked = np.zeros(len(live), bool)
                linked[1:] = same & both
                same = linked[keep][1:]
                rows, size, letters = rows[keep], size[keep], letters[:, keep]
                hashes, nodes = (deque([x[keep] for x in q], self.longest + 1) for q in (hashes, nodes))
                before = None if before is None else before[keep]
            code = letters[d]
            h = hashes[-1] * BASE + code + np.uint64(1)
            same = same & (code[1:] == code[:-1])
            fresh = np.concatenate([[True], ~same])
            node = first - 1 + np.cumsum(fresh)
            r = np.nonzero(fresh)[0]
            kinds = self.ends[self._two(before[r], code[r])] if d else np.full(len(r), 2, "u8")
            edges, here = [], h[r]
            for s in range(1, min(self.longest, d + 1) + 1):
                at = np.nonzero(kinds & np.uint64(1 << min(s, 63)))[0]
                if len(at):
                    of = r[at]
                    k = self.find(here[at] - hashes[-s][of] * self.power[s])
                    hit = np.nonzero(k >= 0)[0]
                    at, of, k = at[hit], of[hit], k[hit]
                    if len(at) or s == 1:
                        edges.append((at, nodes[-s][of], k))
                elif s == 1:
                    edges.append((at, at, at))
            yield Level(first, code[r], nodes[-1][r], edges)
            over = size == d + 1
            ends[rows[over]] = node[over]
            hashes.append(h)
            nodes.append(node)
            before, first = code, first + len(r)

    def blocks(self, words: list[str]) -> Iterator[list[int]]:
        """Places of the words of at most LONG characters, in blocks for levels(): sorted, and of like length."""
        order = sorted(range(len(words)), key=words.__getitem__)
        at = 0
        for band in BANDS:
            part = [i for i in order if at < len(words[i]) <= band]
            yield from (part[a : a + BLOCK] for a in range(0, len(part), BLOCK))
            at = band


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
