"""Postings: which entries of a map task share their key with another owner's, wherever that one is.

An entry is a 64-bit key, an owner and whatever else it carries. Map tasks gather entries and send them
packed, one row for each segment of the key space; the task that a segment falls to sorts what it gets
and passes on the entries of keys that two owners have. Most keys have one owner, so little is passed
on. No filter is broadcast, and segments grow in number with the entries. A task holds entries of
keys that have one owner so far; those of a shared key leave as soon as their buffer is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries that a map task gathers before it sends them, and that a task of segments sorts at once.
SENT, SORTED = 1_000_000, 2_000_000
#: Entries that a segment has on average at most, and segments for each task: a task seldom has to sort more than once.
IN_SEGMENT, FOR_TASK = 100_000, 4
SCHEMA = "kind int, segment int, n int, packed binary"
_NAMES, _TYPES = ["kind", "segment", "n", "packed"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def segments(spark, entries: float) -> int:
    """A power of two: enough for that many entries, and a few for each task."""
    least = max(common.parts(spark) * FOR_TASK, entries / IN_SEGMENT)
    return 1 << int(np.ceil(np.log2(max(2.0, least))))


def _planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, first all lowest bytes: what varies little is compressed well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def row(kind: int, segment: int, n: int, packed: bytes) -> pa.RecordBatch:
    """One row of SCHEMA, for what travels along with the entries."""
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((kind, segment, n, packed), _TYPES)], names=_NAMES)


class Sender:
    """Gathers entries of one kind, columns of equal length of which key (uint64) and owner come first, and packs them."""

    def __init__(self, kind: int, count: int) -> None:
        self.kind, self.shift = kind, np.uint64(64 - int(count).bit_length() + 1)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(columns)
            self.n += len(columns[0])
        if self.n >= SENT:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Rows of SCHEMA, one for each segment that has entries."""
        if not self.n:
            return
        columns = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.n = [], 0
        segment = (columns[0] >> self.shift).astype(np.int32)
        order = np.lexsort((columns[1], segment))
        segment, columns = segment[order], [c[order] for c in columns]
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        last = np.append(first[1:], len(segment))
        packed = [b"".join(_planes(c[a:b]) for c in columns) for a, b in zip(first.tolist(), last.tolist())]
        made = [np.full(len(first), self.kind, np.int32), segment[first], (last - first).astype(np.int32), packed]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, _TYPES)], names=_NAMES)


def dealt(sent: DataFrame, count: int) -> DataFrame:
    """Rows of a Sender, each segment in one task."""
    return sent.repartition(max(common.parts(sent.sparkSession), count // FOR_TASK), "segment")


def unpacked(raw: bytes, n: int, types: list) -> list[np.ndarray]:
    """The columns of a packed row."""
    out, at = [], 0
    for t in map(np.dtype, types):
        size = n * t.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += size
    return out


def packed(*columns: np.ndarray) -> bytes:
    return b"".join(_planes(c) for c in columns)


class Shared:
    """Entries whose key has two owners: columns sorted by key and owner, the first of each key, and how many.
    `whole` tells that nothing of the keys left before and nothing follows. Entries of keys that were passed on
    before have one of those with them, marked in `old`."""

    def __init__(self, columns: list[np.ndarray], old: np.ndarray, first: np.ndarray, whole: np.ndarray) -> None:
        self.columns, self.old, self.first, self.whole = columns, old, first, whole
        self.sizes = np.diff(first, append=len(old))

    def distinct(self, column: int) -> Shared | None:
        """(key, that column): its values for each key, once, where there are several."""
        value = self.columns[column]
        group = np.repeat(np.arange(len(self.first)), self.sizes)
        order = np.lexsort((value, group))
        group, value, key = group[order], value[order], self.columns[0][order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
        several = np.bincount(group[new], minlength=len(self.first)) > 1
        some = new & several[group]
        if not some.any():
            return None
        group = group[some]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        return Shared([key[some], value[some]], np.zeros(len(group), bool), first, self.whole[group[first]])


class Receiver:
    """Takes the packed rows of one kind and gives what they share. types: of the columns; once: an owner's repeats
    of a key go."""

    def __init__(self, types: list, once: bool) -> None:
        self.types, self.once = types, once
        self.held: list[list[np.ndarray]] = []
        self.n, self.limit = 0, SORTED

    def add(self, n: int, raw: bytes) -> Iterator[Shared]:
        self.held.append([*unpacked(raw, n, self.types), np.zeros(n, bool)])
        self.n += n
        if self.n >= self.limit:
            yield from self._settle(False)
            self.limit = self.n + SORTED

    def finish(self) -> Iterator[Shared]:
        if self.n:
            yield from self._settle(True)

    def _settle(self, last: bool) -> Iterator[Shared]:
        *columns, old = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.n = [], 0
        order = np.lexsort((~old, columns[1], columns[0]))
        columns, old = [c[order] for c in columns], old[order]
        key, owner = columns[:2]
        if self.once:
            some = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            columns, old = [c[some] for c in columns], old[some]
            key, owner = columns[:2]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(first, append=len(key))
        known = np.logical_or.reduceat(old, first) | (owner[first] != owner[first + size - 1])
        out = known & (size > np.add.reduceat(old.astype(np.int64), first))
        if not last:
            # one entry stays of a key that has been passed on, and all of a key with one owner
            stays = np.repeat(~known, size)
            stays[first[known]] = True
            marked = old.copy()
            marked[first[known]] = True
            self.held = [[*(c[stays] for c in columns), marked[stays]]]
            self.n = int(stays.sum())
        if out.any():
            some = np.repeat(out, size)
            first = np.cumsum(size[out]) - size[out]
            whole = ~np.logical_or.reduceat(old[some], first) & last
            yield Shared([c[some] for c in columns], old[some], first, whole)


def words(docs: DataFrame) -> float:
    """About how many words all texts have."""
    return (docs.agg(F.sum(F.length("text"))).first()[0] or 0) / 5
