"""Words of many texts at once, as NumPy arrays over their bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Hashes are made over stretches of about this many bytes, which bounds the memory beside the words themselves.
STRETCH = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which every bit of the input reaches every bit of the output."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def inverse(b: int) -> int:
    return pow(int(b), -1, 1 << 64)


def byte_classes(normal: bool) -> np.ndarray:
    """True for bytes of words. normal: ASCII letters and digits and all bytes beyond ASCII; else all but [\\x20\\x09-\\x0D]."""
    out = np.ones(256, bool)
    if normal:
        out[:128] = False
        out[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
    else:
        out[list(b" \t\n\v\f\r")] = False
    return out


@dataclass
class Words:
    start: np.ndarray  # byte where a word starts
    end: np.ndarray
    doc: np.ndarray  # index of its text
    hash: np.ndarray  # uint64
    first: np.ndarray  # n + 1 indexes: the words of text i are first[i]:first[i + 1]


def words(raw: np.ndarray, at: np.ndarray, normal: bool = False) -> Words:
    """The words of the texts raw[at[i]:at[i + 1]]. With normal, raw is lower-cased by the caller."""
    is_word = byte_classes(normal)[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a text starts here
    edge[at] = True
    before = np.zeros(len(raw), bool)
    before[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    first = np.searchsorted(start, at)
    return Words(start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), hashes(raw, start, end), first)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes start:end, which don't overlap and ascend."""
    out = np.zeros(len(start), np.uint64)
    table = mix(np.arange(1, 257, dtype=np.uint64) * MULT)
    cuts = [0]
    while cuts[-1] < len(start):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(end, start[cuts[-1]] + STRETCH, side="right"))))
    longest = max((int(end[j - 1] - start[i]) for i, j in zip(cuts, cuts[1:])), default=0)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, MULT)]))
        downs = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, np.uint64(inverse(MULT)))]))
        total = np.zeros(longest + 1, np.uint64)
        for i, j in zip(cuts, cuts[1:]):
            low, n = start[i], int(end[j - 1] - start[i])
            np.cumsum(table[raw[low : low + n]] * powers[:n], out=total[1 : n + 1])
            out[i:j] = (total[end[i:j] - low] - total[start[i:j] - low]) * downs[start[i:j] - low]
        return mix(out + (end - start).astype(np.uint64) * MIX2)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive hashes; one for each start that has k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mult = mix(np.uint64(2 * seed + 1)) | np.uint64(1)
    with np.errstate(over="ignore"):
        if k <= 12:
            out = np.zeros(n, np.uint64)
            for j in range(k):
                out = out * mult + h[j : j + n]
            return mix(out + np.uint64(k))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), mult)]))
        downs = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), np.uint64(inverse(mult)))]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[:-1])])
        return mix((total[k:] - total[:n]) * downs[:n] + np.uint64(k))


def gram_starts(w: Words, k: int) -> np.ndarray:
    """Whether a gram of k words from each start stays in one text; for as many starts as grams() has."""
    n = len(w.doc) - k + 1
    return w.doc[:n] == w.doc[k - 1 :] if n > 0 else np.zeros(0, bool)
