"""Hashes of word shingles, computed over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at once.
LOT = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 32, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number, and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, LOT)
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, p)]), dtype=np.uint64) for p in (_PRIME, inverse)]
    return _powers[0], _powers[1]


def _lot(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts, and the number of shingles of each text, repeated ones included."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (data == 32) | (data >= 9) & (data <= 13)
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    word = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, ends)  # words up to the end of each text
    n = np.diff(upto, prepend=0)
    doc = np.repeat(np.arange(len(texts)), n)
    out = word * _PLACE[0]
    for k in range(1, size):
        out[:-k] += np.where(doc[k:] == doc[:-k], word[k:] * _PLACE[k], np.uint64(0))
    # The whole sequence of a text of fewer words, told from longer ones by its length.
    short = n[doc] < size
    out[short] += n[doc][short].astype(np.uint64) * _PLACE[-1]
    kept = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = upto - n
    place = np.arange(len(word)) - first[doc]
    return mix(out[place < kept[doc]]), kept


def sets(texts: list[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are what stands between ASCII white space, with A to Z in lower case. A text of fewer than ``size`` words
    has one shingle, one without words none.
    """
    lot: list[bytes] = []
    n = 0

    def hashed() -> Iterator[np.ndarray]:
        found, kept = _lot(lot, size)
        at = 0
        for k in kept.tolist():
            yield np.unique(found[at : at + k])
            at += k

    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
        if lot and n + len(raw) > LOT:
            yield from hashed()
            lot, n = [], 0
        lot.append(raw)
        n += len(raw) + 1
    if lot:
        yield from hashed()
