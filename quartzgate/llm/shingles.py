"""Words and word shingles of whole texts as 64-bit hashes, many texts at once."""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters close ones."""
    h = h ^ np.uint64(salt * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _random(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN, salt)


#: A random number for each byte, and an odd one for each place in a word.
BYTES, PLACES = _random(256, 1), _random(1 << 14, 2) | np.uint64(1)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last, number per text) of all words, A-Z lower-cased, cut at white
    space (space, tab, line breaks, vertical tab and form feed). Bytes count within all texts joined by one byte each."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    upto = np.searchsorted(begins, np.cumsum([len(r) + 1 for r in raw]))
    counts = np.diff(np.concatenate([[0], upto]))
    size = ends - begins
    if not len(size):
        return np.zeros(0, np.uint64), begins, ends, counts
    offset = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(offset, size)
    if size.max() > len(PLACES):
        place = PLACES[within % len(PLACES)] + (within // len(PLACES)).astype(np.uint64) * np.uint64(2)
    else:
        place = PLACES[within]
    return mix(np.add.reduceat(BYTES[codes[~blank]] * place, offset) + size.astype(np.uint64)), begins, ends, counts


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, without regard to where texts end: entry i covers i to i + k - 1."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, np.uint64(k))
    odd = _random(k, 3) | np.uint64(1)
    for j in range(k):
        out += h[j : j + n] * odd[j]
    return mix(out)


def sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct k-word shingles; with fewer words, of the whole sequence
    as one; empty without words."""
    h, _, _, counts = words(texts)
    run = rolling(h, k)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(run[at : at + n - k + 1]))
        elif n:
            out.append(rolling(h[at : at + n], n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
