"""Hashes of words and shingles, computed on a text's UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np

_U64 = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Words hashed at once; bounds the work space of very long texts.
BLOCK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values by rule."""
    return mix(np.arange(1, n + 1, dtype=_U64) * _U64(_GOLDEN) + _U64(seed * 0x632BE59BD9B4E019 & _MASK))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, _U64)
    out[1:] = _U64(base)
    return np.multiply.accumulate(out)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words between white space, and of words of letters and digits with all beyond ASCII.
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_VALUES = stream(1, 256)
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_BASE = 0xD6E8FEB86659FD93
_POWERS = _powers(4096, _BASE)
_PLACES = stream(2, 64) | _U64(1)


def spans(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    edges = np.flatnonzero(np.diff(is_word[raw], prepend=False, append=False))
    return edges[::2], edges[1::2]


def word_hashes(text: bytes, is_word: np.ndarray = NOT_SPACE) -> np.ndarray:
    """A 64-bit hash of each word in order, A-Z lower-cased; a polynomial in the word's bytes, scrambled."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = spans(raw, is_word)
    parts = [_hash_block(raw, starts[i : i + BLOCK], ends[i : i + BLOCK], is_word) for i in range(0, len(starts), BLOCK)]
    return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty(0, _U64)])


def _hash_block(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    part = raw[starts[0] : ends[-1]]
    letters = part[is_word[part]]
    lengths = ends - starts
    offsets = np.cumsum(lengths) - lengths
    at = np.arange(len(letters)) - np.repeat(offsets, lengths)
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest, _BASE)
    return mix(np.add.reduceat(_VALUES[letters] * powers[at], offsets) + lengths.astype(_U64))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; empty where there are fewer."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, _U64)
    total = np.full(size, _U64(n))
    for j in range(n):
        total += words[j : j + size] * _PLACES[j]
    return mix(total)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text is one shingle, a text without words has none."""
    if 0 < len(words) < n:
        return ngrams(words, len(words))
    return np.unique(ngrams(words, n))
