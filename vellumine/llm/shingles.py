"""Word shingle sets of whole texts as sorted 64-bit hashes, computed on arrays of bytes."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BATCH = 1 << 20
_P, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            step = np.full(n + _BATCH // 8, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0], _powers[1]


def _batch(docs: list[bytes]) -> list[np.ndarray]:
    buf = np.frombuffer(b"\n" + b"\n".join(docs) + b"\n", np.uint8)
    buf = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    power, inverse = _power(len(buf))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], dtype=np.uint64)])
    word = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(_MIX1))
    sizes = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]) + 1)
    n = len(word)
    five = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        five += word[k : k + len(five)] * _PLACES[k]
    five = mix(five)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            out.append(np.unique(five[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix((word[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's distinct 5-word shingles (its whole word sequence if it has fewer words, none
    if it has no word), A-Z in lower case, as ascending hashes."""
    out: list[np.ndarray] = []
    docs: list[bytes] = []
    size = 0
    for t in texts:
        docs.append((t or "").encode())
        size += len(docs[-1])
        if size >= _BATCH:
            out += _batch(docs)
            docs, size = [], 0
    return out + (_batch(docs) if docs else [])


def signature(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(_P))) if len(s) else 0], np.uint64).tobytes()
