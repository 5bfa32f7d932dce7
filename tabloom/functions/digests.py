"""MD5 of many short texts at once: the hash behind `rng.u01`, worked out in arrays inside a task."""

from __future__ import annotations

import hashlib
import math

import numpy as np

TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
LEFT = [np.array(t, np.uint32) for t in TURNS]  # arrays without axes: numpy takes them twice as fast as numbers
RIGHT = [np.array(32 - t, np.uint32) for t in TURNS]
ADDED = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
PLACE = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
ONE_BLOCK = 55  # longest text, in bytes, that MD5 takes in one round


def _steps(state, first: int, last: int, words: dict[int, np.ndarray], blocks: np.ndarray) -> list[np.ndarray]:
    """State of the digests after the steps first..last - 1. words: the words of the text that differ along the last axis;
    blocks: the 16 words of each row of digests, without these. Writes over the state."""
    a, b, c, d = state
    f, t, x = np.empty_like(a), np.empty_like(a), np.empty_like(a)
    add, xor, both, either = np.add, np.bitwise_xor, np.bitwise_and, np.bitwise_or
    left, right, flip = np.left_shift, np.right_shift, np.invert
    added = blocks[:, PLACE] + ADDED
    alike = (blocks == blocks[0]).all(axis=0)
    for i in range(first, last):
        if i < 16:
            xor(c, d, f); both(f, b, f); xor(f, d, f)  # noqa: E702
        elif i < 32:
            xor(b, c, f); both(f, d, f); xor(f, c, f)  # noqa: E702
        elif i < 48:
            if i % 2 == 0 or i == first:
                xor(b, c, x); xor(x, d, f)  # noqa: E702
            else:  # b and c of the step before are c and d now
                xor(x, b, f)
        else:
            flip(d, f); either(f, b, f); xor(f, c, f)  # noqa: E702
        add(f, a, f)
        add(f, added[0, i, ...] if alike[PLACE[i]] else added[:, i : i + 1], f)
        if PLACE[i] in words:
            add(f, words[PLACE[i]], f)
        left(f, LEFT[i], t)
        right(f, RIGHT[i], f)
        either(f, t, f)
        add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    return [a, b, c, d]


class Heads:
    """Texts of one length whose MD5 is asked for under many endings. Words that all texts share are numbers, and the
    steps before the first word that an ending reaches are worked out once."""

    def __init__(self, heads: list[bytes]):
        self.heads, self.size = heads, len(heads[0])
        if self.size > ONE_BLOCK:
            return
        self.whole = self.size // 4
        text = np.zeros((len(heads), 4 * self.whole + 4), np.uint8)
        text[:, : self.size] = np.frombuffer(b"".join(heads), np.uint8).reshape(-1, self.size) if self.size else 0
        columns = np.ascontiguousarray(text.view("<u4").T)
        self.words = {i: w for i, w in enumerate(columns) if (w != w[0]).any()}
        self.shared = sum(int(w[0]) << 32 * i for i, w in enumerate(columns) if i not in self.words)
        start = [np.full((1, len(heads)), s) for s in START]
        self.state = _steps(start, 0, self.whole, self.words, self._blocks([0]))

    def _blocks(self, endings: list[int]) -> np.ndarray:
        return np.frombuffer(b"".join((self.shared + e).to_bytes(64, "little") for e in endings), "<u4").reshape(-1, 16)

    def _state(self, tails: list[bytes], last: int) -> list[np.ndarray]:
        """State after the steps up to `last`: one row of digests for each tail."""
        endings = [(int.from_bytes(t + b"\x80", "little") << 8 * self.size) + (8 * (self.size + len(t)) << 32 * 14) for t in tails]
        return _steps([np.repeat(x, len(tails), axis=0) for x in self.state], self.whole, last, self.words, self._blocks(endings))

    def leading_bits(self, tail: bytes) -> np.ndarray:
        """First 52 bits of the MD5 of head + tail."""
        if self.size + len(tail) > ONE_BLOCK:
            return np.array([int.from_bytes(hashlib.md5(h + tail).digest()[:8], "big") >> 12 for h in self.heads], np.uint64)
        a, b, _, _ = (x[0] for x in self._state([tail], 64))
        a, b = a + START[0], b + START[1]
        return (a.byteswap().astype(np.uint64) << np.uint64(20)) | (b.byteswap().astype(np.uint64) >> np.uint64(12))

    def reached(self, tails: list[bytes], steps: np.ndarray) -> np.ndarray:
        """How many of the `steps` the first 52 bits of the MD5 of head + tail are not below: one row for each tail. The first
        32 bits, known three steps before the end, decide unless they are those of a step; then all bits are taken."""
        if self.size + max(map(len, tails)) > ONE_BLOCK:
            return np.array([np.searchsorted(steps, self.leading_bits(t), side="right") for t in tails], np.uint8)
        top = self._state(tails, 61)[1]
        np.add(top, START[0], top)
        top.byteswap(inplace=True)
        counts, is_so, open_rows = np.zeros(top.shape, np.uint8), np.empty(top.shape, np.bool_), set()
        for step in (steps >> np.uint64(20)).astype(np.uint32):
            step = step.reshape(())
            np.add(counts, np.greater(top, step, is_so).view(np.uint8), counts)
            if np.equal(top, step, is_so).any():
                open_rows |= set(np.flatnonzero(is_so.any(axis=1)).tolist())
        for i in open_rows:
            counts[i] = np.searchsorted(steps, self.leading_bits(tails[i]), side="right")
        return counts


def leading_bits(heads: list[bytes], tail: bytes) -> np.ndarray:
    """First 52 bits of the MD5 of head + tail, for heads of one length."""
    return Heads(heads).leading_bits(tail)
