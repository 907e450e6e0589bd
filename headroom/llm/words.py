"""Words and word shingles of many texts at once, as arrays of 64-bit hashes.

A word is a run of letters, digits and characters outside ASCII, in lower case. All of it is
numpy over the bytes of an Arrow column, so that no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from headroom.llm.arrow import utf8

SHINGLE = 5
_BYTE = np.arange(256)
IN_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
#: Keeps the first n of eight bytes.
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
MISSING = np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit numbers (a bijection); the argument is overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    hashes: np.ndarray  # uint64, one for each word
    bounds: np.ndarray  # the words of text i are bounds[i]:bounds[i + 1]
    starts: np.ndarray  # byte where the word begins, in the joined lower-case text
    ends: np.ndarray
    raw: np.ndarray
    text_at: np.ndarray  # byte where each text begins


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, read eight bytes at a time."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left, at = ends - starts, starts.copy()
    hashes = left.astype(np.uint64) * ODD[0]
    active = np.arange(len(starts))
    while len(active):
        part = eights[at[active]] & KEEP[np.minimum(left[active], 8)]
        hashes[active] = mix(hashes[active] * ODD[1] ^ part)
        at[active] += 8
        left[active] -= 8
        active = active[left[active] > 0]
    return hashes


def words_of(texts: pa.Array) -> Words:
    raw, text_at = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    inside = IN_WORD[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first, last = text_at[:-1], text_at[1:] - 1
    full = last >= first
    before[first[full]] = False
    after[last[full]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(hash_spans(raw, starts, ends), np.searchsorted(starts, text_at), starts, ends, raw, text_at)


def shingles_of(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their bounds; a shorter text has one shingle of all its words."""
    n = np.diff(words.bounds)
    counts = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(bounds[-1]) + np.repeat(words.bounds[:-1] - bounds[:-1], counts)
    end = np.repeat(words.bounds[1:], counts)
    padded = np.concatenate([words.hashes, np.full(size, MISSING)])
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        word = padded[at + j]
        word[at + j >= end] = MISSING
        total = (total ^ word) * ODD[j % len(ODD)]
        total ^= total >> np.uint64(29)
    return mix(total), bounds


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each element the text that it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
