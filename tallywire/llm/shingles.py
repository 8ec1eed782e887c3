"""Word shingles of whole texts as 64-bit hashes, computed for many texts at a time."""

from __future__ import annotations

import numpy as np

from tallywire.llm.editembed import mix

_ONE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ONE) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]  # of each byte, the random number of its lower case
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of one text that are hashed at a time.
PART = 4 << 20


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text: its bytes between blanks, A-Z as a-z."""
    if len(data) > PART:
        out, at = [], 0
        while at < len(data):
            stop = min(at + PART, len(data))
            while stop < len(data) and not _BLANK[data[stop]]:
                stop += 1
            out.append(_word_hashes(data[at:stop])[0])
            at = stop
        return np.concatenate(out)
    return _word_hashes(data)[0]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and where each begins."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_BLANK[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), begin
    size = end - begin
    power = np.cumprod(np.full(int(size.max()), _ONE | np.uint64(1), dtype=np.uint64))
    where = np.flatnonzero(inside)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(where)) - np.repeat(first, size)
    return mix(np.add.reduceat(_BYTE[raw[where]] * power[place], first) + size.astype(np.uint64)), begin


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole, if there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * factor[i]
    return mix(total + np.uint64(width))


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    small = [t if t and len(t) <= PART else b"" for t in texts]
    hashes, begin = _word_hashes(b"\n".join(small))
    starts = np.cumsum([0] + [len(t) + 1 for t in small])
    cuts = np.searchsorted(begin, starts)
    for t, a, b in zip(texts, cuts.tolist(), cuts[1:].tolist(), strict=False):
        words = word_hashes(t) if t and len(t) > PART else hashes[a:b]
        s = np.sort(shingle_hashes(words, k))
        if len(s) > 1:
            s = s[np.append(True, s[1:] != s[:-1])]
        out.append(s)
    return out
