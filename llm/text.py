"""Vectorised tokenising and hashing of whole texts, shared by the operators of this subpackage.

Texts arrive as Arrow string arrays. All work is done on their UTF-8 bytes with numpy: a word is a maximal run of bytes
of a class, and its hash is a polynomial over a fixed random value for each byte, modulo 2**64, found for all words at
once from one running sum. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that are hashed at once; a longer text is a piece of its own.
PIECE = 512 << 10

_rng = np.random.Generator(np.random.PCG64(20240611))
_VALUE = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | U(1)
_BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_class(name: str) -> np.ndarray:
    """Which bytes belong to words. space: all but ASCII white space. plain: digits, letters a-z and all non-ASCII."""
    if name == "space":
        t = np.ones(256, bool)
        t[list(_WHITE)] = False
        return t
    if name == "plain":
        t = np.zeros(256, bool)
        t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
        return t
    raise ValueError(f"unknown class of bytes: {name}")


_CLASS = {k: byte_class(k) for k in ("space", "plain")}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    got = _powers.get(which)
    if got is None or len(got[0]) < n:
        n = max(n, PIECE) + 16
        up, down = np.full(n, U(_BASE[which])), np.full(n, U(pow(_BASE[which], -1, 2**64)))
        up[0] = down[0] = U(1)
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if n > 4 * PIECE:  # for one very long text; not kept
            return up, down
        _powers[which] = got = up, down
    return got


class Words:
    """The words of some texts in order. first[i]:first[i + 1] are those of text i; start, end: their bytes in raw."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.raw, self.start, self.end, self.first = raw, start, end, first

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        up, down = _power(len(self.raw), which)
        run = np.empty(len(self.raw) + 1, U)
        run[0] = 0
        np.cumsum(_VALUE[which][self.raw] * up[: len(self.raw)], out=run[1:])
        return mix((run[self.end] - run[self.start]) * down[self.start] + (self.end - self.start).astype(U))

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()

    def text_of(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts and their offsets, nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(texts: pa.Array, kind: str = "space", lower: bool = False) -> Words:
    raw, off = _buffers(texts)
    if lower:
        raw = _LOWER[raw]
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _CLASS[kind][raw]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = off[(off > 0) & (off < n)]  # a word does not go on from one text into the next
    starts[edge] |= inside[edge + 1]
    ends[edge - 1] |= inside[edge]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(raw, start, end, np.searchsorted(start, off))


def pieces(texts: pa.Array, most: int = PIECE):
    """(from, to) over the texts, so that each piece has at most so many bytes or one text."""
    _, off = _buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def windows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words within one text, and at which word each starts."""
    total = len(h)
    if total < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    size, acc = 1, h
    done, out = 0, None
    m = total - n + 1
    rest = n
    while rest:  # by doubling: a window of n words is put together from windows of powers of two
        if rest & 1:
            part = acc[done : done + m]
            out = part if out is None else mix(out * U(0x9E3779B97F4A7C15) + part + U(size))
            done += size
        rest >>= 1
        if rest:
            acc = mix(acc[:-size] * U(0xD6E8FEB86659FD93) + acc[size:] + U(size))
            size *= 2
    last = np.repeat(first[1:], np.diff(first))[:m]
    at = np.flatnonzero(np.arange(m) + n <= last)
    return out[at], at


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of so many words lie in a window of n words that starts at one of these."""
    d = np.zeros(total + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + n, total), -1)
    return np.cumsum(d[:-1]) > 0
