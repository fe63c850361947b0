"""Vectorised word and shingle hashing over the bytes of Arrow strings.

All separators used here are ASCII, so words can be cut on UTF-8 bytes.  A
block holds the bytes of several whole documents; every function works on the
block at once with numpy and keeps document borders through offset arrays.
Nulls count as empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Bytes of a word from which on its hash is a digest.
LONG = 256
_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n 64-bit values from a counter (the SplitMix64 finaliser)."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = _splitmix(256, 7)[_LOWER]           # A-Z and a-z share a code
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)
_LENGTH_CODE = np.uint64(0xA0761D6478BD642F)

#: Words are runs of bytes that are not x20 or x09-x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base & _MASK, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * BLOCK_BYTES:
            _powers[name] = have
    return have[:n]


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about
    ``limit`` bytes; a longer text is a block of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    raw = texts.buffers()
    offs = np.frombuffer(raw[1], np.int64 if wide else np.int32)
    offs = offs[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def word_bounds(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the word offsets of the texts."""
    mask = is_word[buf]
    first, last = mask.copy(), mask.copy()
    if len(buf):
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        full = offs[1:] > offs[:-1]
        at, end = offs[:-1][full], offs[1:][full] - 1
        first[at] = mask[at]
        last[end] = mask[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = SPACED
                ) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, A-Z folded, and the word offsets of the texts.

    A polynomial over 64-bit byte codes from one running sum, finalised by a
    mixer.  Modulo 2**64 such polynomials have equal values for crafted words of
    1 024 bytes and more, so words beyond ``LONG`` bytes get a BLAKE2 digest."""
    starts, ends, offsets = word_bounds(buf, offs, is_word)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    run = _BYTE_CODE[buf]
    run *= _power("p", _BASE, len(buf))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(run, dtype=np.uint64)])
    value = (run[ends] - run[starts]) * _power("i", _INVERSE, len(buf))[starts]
    value += (ends - starts).astype(np.uint64) * _LENGTH_CODE
    value = mix(value)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        word = _LOWER[buf[starts[i]:ends[i]]].tobytes()
        value[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return value, offsets


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of given words, equal to those of :func:`word_hashes`."""
    block = pa.array(words, pa.string())
    out = [word_hashes(b, o, np.ones(256, bool))[0] for _, _, b, o in text_blocks(block)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, k: int, plus: int = 0) -> np.ndarray:
    """Hash of each run of k words, borders of texts ignored (n - k + 1 values)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = words[:n].copy()
    for j in range(1, k):
        value *= _SHINGLE_BASE
        value += words[j:j + n]
    return mix(value + np.uint64(plus))


def run_hashes(words: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside a text, equal to that of a text of n words
    that is shorter than a shingle, and the texts' offsets."""
    value = gram_hashes(words, n, n)
    end = np.repeat(offs[1:], np.diff(offs))
    valid = np.arange(len(value)) + n <= end[:len(value)]
    count = np.maximum(np.diff(offs) - n + 1, 0)
    return value[valid], np.concatenate([[0], np.cumsum(count)])


def shingle_hashes(words: np.ndarray, offs: np.ndarray, k: int = 5
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of k words of each text in order, and their offsets.  A text of
    fewer words has its whole sequence as one; one without words has none."""
    count = np.diff(offs)
    short = np.flatnonzero((count > 0) & (count < k))
    value = np.zeros(len(words), np.uint64)
    grams = gram_hashes(words, k)
    value[:len(grams)] = grams
    end = np.repeat(offs[1:], count)
    valid = np.arange(len(words)) + k <= end
    for t in short:
        run = 0
        for w in words[offs[t]:offs[t + 1]]:
            run = (run * int(_SHINGLE_BASE) + int(w)) & _MASK
        value[offs[t]] = mix(np.array([run + int(count[t])], np.uint64))[0]
        valid[offs[t]] = True
    n = np.maximum(count - k + 1, 0)
    n[short] = 1
    return value[valid], np.concatenate([[0], np.cumsum(n)])


def distinct_sets(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offs[:-1], offs[1:])]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def list_array(flat: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Arrow list of 64-bit integers (the bits of ``flat``) for Spark."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)),
                                    pa.array(flat.view(np.int64)))
