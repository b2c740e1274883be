"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed in numpy over blocks of texts.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after lower-casing ``A-Z`` only. A text with
fewer words than a shingle has its whole word sequence as its only shingle; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
# Texts are hashed in blocks of about this many bytes, so that the temporary arrays stay in the CPU cache and in memory.
BLOCK_BYTES = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C13  # odd, so it has an inverse modulo 2^64; its value less 1 is not divisible by 4


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _letter_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]  # A-Z as a-z
    return values


def separators(characters: bytes) -> np.ndarray:
    """The table of the bytes that separate words."""
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


_LETTERS = _letter_values()
_SPACE = separators(b" \t\n\x0b\x0c\r")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _MULTIPLIER, dtype=U64)
        down = np.full(n, pow(_MULTIPLIER, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


_UP, _DOWN = _powers(BLOCK_BYTES + 2)


def text_blocks(texts: Sequence[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` bytes together, or of one longer text."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) + 1 > limit:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: Sequence[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and for each text the number of words up to its end."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    outside = space[raw]
    edge = np.flatnonzero(np.diff(outside.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = (_UP, _DOWN) if len(raw) < len(_UP) else _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=U64)
        np.cumsum(_LETTERS[raw] * up[: len(raw)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    return hashes, np.searchsorted(starts, ends_of_text)


def shingle_sets(texts: Sequence[bytes], words: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles of ``words`` words."""
    for a, b in text_blocks(texts):
        hashes, until = word_hashes(texts[a:b])
        with np.errstate(over="ignore"):
            whole = max(0, len(hashes) - words + 1)
            rolled = np.zeros(whole, dtype=U64)
            for k in range(words):
                rolled = rolled * U64(0x2545F4914F6CDD1D) + hashes[k : k + whole]
            rolled = mix(rolled)
            first = 0
            for last in until:
                n = last - first
                if n >= words:
                    yield np.unique(rolled[first : last - words + 1])
                elif n:
                    short = U64(n)
                    for h in hashes[first:last]:
                        short = short * U64(0x9FB21C651E98DF25) + h
                    yield mix(np.array([short], dtype=U64))
                else:
                    yield np.empty(0, dtype=U64)
                first = last
