"""Words, shingles and signatures of texts, as numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
#: ASCII letters, lower-cased, and digits as they are, all else as blanks.
_ALNUM = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
#: The same with line breaks kept and each digit as 0.
_ALNUM_LINES = _ALNUM[:10] + b"\n" + _ALNUM[11:48] + b"0" * 10 + _ALNUM[58:]
_DIGITS = re.compile(r"\d+")
_SEEN: dict[str, int] = {}
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return text.encode().translate(_ALNUM).decode().split() if text.isascii() else _WORD.findall(text.lower())


def line_words(text: str) -> list[list[str]]:
    """``words`` of each line, every run of digits as one 0."""
    if text.isascii():
        flat = text.encode().translate(_ALNUM_LINES)
        while b"00" in flat:
            flat = flat.replace(b"00", b"0")
        return [line.split() for line in flat.decode().split("\n")]
    return [words(line) for line in _DIGITS.sub("0", text).split("\n")]


def word_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes of words, equal in every process."""
    if len(_SEEN) > 400_000:
        _SEEN.clear()
    for w in set(ws).difference(_SEEN):
        _SEEN[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_SEEN.__getitem__, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _mul(i: int) -> np.uint64:
    return _MUL[i % len(_MUL)] + np.uint64(2 * (i // len(_MUL)))


def text_hash(ws: list[str]) -> int:
    """One signed 64-bit hash of a sequence of words."""
    return xxhash.xxh64_intdigest(" ".join(ws)) - (1 << 63)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order; a shorter text is one run."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        k = n
    out = h[: n - k + 1] * _MUL[0]
    for i in range(1, k):
        out = mix(out) + h[i : n - k + 1 + i] * _mul(i)
    return mix(out)


_SHIFT = np.arange(64, dtype=np.uint64)


def simhash(h: np.ndarray) -> int:
    """64-bit SimHash of the features, as a signed integer; 0 without features."""
    if len(h) == 0:
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    up = bits.sum(axis=0, dtype=np.int32) * 2 > len(h)
    return int(np.packbits(up, bitorder="little").view(np.int64)[0])


def permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def minhash(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 32-bit minimum per permutation over distinct 32-bit hashes."""
    return (a[:, None] * sh[None, :] + b[:, None]).min(axis=1)
