"""Runs of words that repeat with a period, found by counting matches at each lag.

A run of period q with length L has L - q consecutive places whose words match those q places on. So a lag matters only
if at least max(6, 4 q) - q places match in the whole text, and how many do is known for every lag at once: for frequent
(heavy) words from the autocorrelation of where they stand, by FFT and rounded, as counts are whole; for rare (light) ones
from the differences between their places. Only lags with enough matches get a scan for islands of consecutive matches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import common

#: A run holds REPEATS periods and LEAST words at least.
REPEATS, LEAST = 4, 6
RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _fft_size(n: int) -> int:
    """The least 2^a, 3 * 2^a or 5 * 2^a from n on."""
    return min(k << max(0, (-(-n // k) - 1).bit_length()) for k in (1, 3, 5))


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """For each lag from 0 to `most` (0 stays 0) the number of places whose word stands again that many places on."""
    n = len(ids)
    found = np.zeros(most + 1, np.int64)
    by_word = np.argsort(ids, kind="stable")
    times = np.bincount(ids)
    size = _fft_size(n + most)
    # pairs of a word cost half its number squared, its transform size * log(size)
    heavy = times > np.sqrt(size * np.log2(size) / 8)
    if heavy.any():
        power = np.zeros(size // 2 + 1)
        for w in np.flatnonzero(heavy):
            spectrum = np.fft.rfft((ids == w).astype(float), size)
            power += spectrum.real**2 + spectrum.imag**2
        found += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        found[0] = 0
    place = by_word[~heavy[ids[by_word]]]
    last = np.cumsum(times[~heavy])  # where each light word's places end
    left = np.repeat(last, times[~heavy]) - np.arange(len(place)) - 1
    at = np.flatnonzero(left > 0)
    step = 1
    while len(at):
        lag = place[at + step] - place[at]
        near = lag <= most  # places ascend, so farther ones of the same word are farther still
        at, lag = at[near], lag[near]
        found += np.bincount(lag, minlength=most + 1)
        step += 1
        at = at[left[at] >= step]
    return found


def islands(ids: np.ndarray, lag: int, least: int) -> np.ndarray:
    """(start, length) of the maximal stretches of `least` or more places whose words stand again `lag` places on.

    Each holds a whole block of half that size. Blocks are dropped at their first mismatch, so nearly all of them
    cost a look or two; neighbouring whole ones are one stretch and grow into the blocks beside them."""
    n, half = len(ids) - lag, (least + 1) // 2
    whole = np.arange(max(0, n // half)) * half
    seen, step = 0, 1
    while len(whole) and seen < half:
        at = whole[:, None] + np.arange(seen, min(seen + step, half))
        whole = whole[(ids[at] == ids[at + lag]).all(1)]
        seen, step = seen + step, 2 * step
    if not len(whole):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(whole, prepend=-2 * half) > half)
    begin, end = whole[cut], whole[np.append(cut[1:], len(whole)) - 1] + half

    def grown(at: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < n)
        at = np.where(inside, at, 0)
        same = inside & (ids[at] == ids[at + lag])
        return np.where(same.all(1), half, same.argmin(1))

    begin, end = begin - grown(begin[:, None] - np.arange(1, half + 1)), end + grown(end[:, None] + np.arange(half))
    keep = end - begin >= least
    return np.stack([begin[keep], end[keep] - begin[keep]], 1)


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period.

    Lags ascend. A run of period p matches at the multiples of p as well; those matches are taken off their lags' counts,
    as a run with another smallest period shares none of them: two such runs overlap in less than the longer period."""
    n = len(ids)
    if n < LEAST:
        return []
    most = n // REPEATS
    lags = np.arange(most + 1)
    least = np.maximum(LEAST, REPEATS * lags) - lags
    counts = lag_counts(ids, most)
    found: dict[tuple[int, int], int] = {}
    for lag in np.flatnonzero(counts >= least).tolist():
        if lag and counts[lag] >= least[lag]:
            for start, length in islands(ids, lag, int(least[lag])).tolist():
                run = (start, length + lag)
                if run not in found:  # else it has a smaller period
                    found[run] = lag
                    multiples = lags[2 * lag : length + lag : lag]
                    counts[multiples] -= length + lag - multiples
    return sorted((start, length, lag) for (start, length), lag in found.items())


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words outside of what repeats: of each run only the first period stays."""
    if not found:
        return b" ".join(words).decode("utf-8", "surrogatepass")
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    return b" ".join(words[i] for i in np.flatnonzero(~gone).tolist()).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, first: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """`docs` with `runs`, an array of (start, length, period) in words from 0, and `collapsed`, the text that is left when of
    each run only the first period stays, words joined by one space. Columns of those names are replaced.

    Words are what lies between ASCII blanks. A run is a stretch of consecutive words with a smallest period q, 4 q and 6
    words long at least, that can't be extended on either side. `first`(doc_id, words) may change a row's words
    beforehand. Null and empty texts and ones without words have no runs and an empty `collapsed`; rows with a null or a
    repeated doc_id are rows like others. A text's memory is some hundred bytes a word. Empty table: empty result.
    """

    def make(batch) -> dict[str, list]:
        out: dict[str, list] = {"runs": [], "collapsed": []}
        ids = batch.column("doc_id").to_pylist() if first else [None] * len(batch)
        for doc_id, text in zip(ids, batch.column("text").to_pylist()):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            if first:
                words = first(doc_id, words)
            found = runs(numbers(words)) if len(words) >= LEAST else []
            out["runs"].append([dict(zip(("start", "length", "period"), r)) for r in found])
            out["collapsed"].append(collapsed(words, found))
        return out

    return common.map_rows(docs, make, {"runs": RUNS, "collapsed": "string"})


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Make a tenth of all documents periodic from some word on, as their ids' CRC-32 says; a null id stays as it is."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    unit = words[start : start + period]
    return words[:start] + (unit * -(-(n - start) // period))[: n - start]


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties: smallest start, then period; nulls
    without one), runs_sha256 and collapsed_sha256, over the words that `planted` leaves. Odd rows as in find_runs."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_runs(narrow, planted)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    order = F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))
    best = F.array_min(order)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("listed"), "collapsed")
    length, period = -F.col("best.col1"), F.col("best.period")
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
