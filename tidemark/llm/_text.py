"""Vectorised word and n-gram hashing over whole Arrow batches of text.

Words are the maximal runs of characters other than U+0020 and U+0009..U+000D. All of these are ASCII, so the UTF-8
bytes can be cut without decoding. A word's hash is a polynomial over its bytes, taken from prefix sums modulo 2**64
and finalised by a mixer; a gram's hash is the same construction over the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 19
U64 = np.uint64
_BYTE, _WORD = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser with full avalanche."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in [0, n)."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = -(-n // (1 << 16)) << 16
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, U64(b), dtype=U64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U64))
        _powers[base] = (made[0], made[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, UTF-8 bytes, offsets of its rows) in pieces of about CHUNK_BYTES; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, side="right")) - 1)
        hi = min(hi, n)
        yield lo, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] |= 32
    return out


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more at the end)."""
    inside = IS_WORD[buf]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = offs[offs < len(buf)]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    edge = offs[1:]
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(_BYTE, len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


class Grams:
    """Hashes of any runs of words, from prefix sums over the words' hashes."""

    def __init__(self, hashes: np.ndarray, seed: int = 0) -> None:
        base = (_WORD + 2 * seed) | 1
        up, self.down = powers(base, len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=U64)
        np.cumsum((mixed(hashes + U64(seed)) if seed else hashes) * up[: len(hashes)], out=self.sums[1:])

    def __call__(self, first: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Of the n words from each index in first."""
        return mixed((self.sums[first + n] - self.sums[first]) * self.down[first])
