"""Word shingles of many texts at once, as 64-bit hashes, in NumPy arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS_A_SHINGLE = 5
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
#: Bytes of text that are hashed together (or one text).
BLOCK_BYTES = 500_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: np.uint64) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]), dtype=np.uint64)

    return powers(BASE), powers(INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k = 0 .. n at least."""
    return _powers(max(BLOCK_BYTES, 1 << (n - 1).bit_length() if n > BLOCK_BYTES else 0))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingles of text k, ascending, are hashes[ends[k] : ends[k + 1]].

    A word is a run of bytes other than white space. A text of fewer words than a shingle has, but at least one, has
    one shingle of all its words.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    whole = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    up, down = powers(len(whole))
    space = _SPACE[whole]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    stops = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((whole.astype(np.uint64) + np.uint64(1)) * up[: len(whole)], dtype=np.uint64)])
    words = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    upto = np.concatenate([[0], np.searchsorted(starts, ends_of_texts)])  # words before the end of each text
    n_words = np.diff(upto)
    text_of = np.repeat(np.arange(len(texts)), n_words)
    left = upto[1:][text_of] - np.arange(len(words))  # words from this one to the text's end
    grams = np.zeros(len(words), np.uint64)
    for k in range(WORDS_A_SHINGLE):
        n = max(0, len(words) - k)
        grams[:n] += np.where(left[:n] > k, words[k:] * up[k + 1], np.uint64(0))
    first = np.zeros(len(words), bool)
    first[upto[:-1][n_words > 0]] = True
    keep = (left >= WORDS_A_SHINGLE) | (first & (n_words[text_of] < WORDS_A_SHINGLE))
    grams, text_of = mix(grams[keep]), text_of[keep]
    order = np.lexsort((grams, text_of))
    grams, text_of = grams[order], text_of[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (text_of[1:] != text_of[:-1])]) if len(grams) else np.zeros(0, bool)
    grams, text_of = grams[new], text_of[new]
    return grams, np.searchsorted(text_of, np.arange(len(texts) + 1))
