"""Spans of whole texts met in one sorted sweep, for texts with any number of them.

The functions of functions.spans fold spans against spans, which suits short texts; these give the same results from sorted
arrays, in one Arrow pass over the rows. A claim looks up its neighbours among those claimed so far, pairs come from a merge
of starts and ends, and coverage from the union of intervals.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

Span = tuple[int, int, str]
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("label", StringType())]))
PAIRS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("kind", "p", "g")]))
#: Rows that are in Python at a time.
ROWS = 256


def mapped(df: DataFrame, columns: list[str], make: Callable[..., dict], new: dict) -> DataFrame:
    """`df` with the columns of `new` (types by name), made for each row from the values of `columns`. Columns of those names are
    replaced, all others pass as they are."""
    fields = [f for f in df.schema.fields if f.name not in new]
    schema = StructType([*fields, *[StructField(n, t) for n, t in new.items()]])
    types = {f.name: f.type for f in to_arrow_schema(schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.slice(at, ROWS)
                made = [make(*row) for row in zip(*(b.column(c).to_pylist() for c in columns))]
                arrays = [b.column(f.name) for f in fields] + [pa.array([m[n] for m in made], types[n]) for n in new]
                yield pa.RecordBatch.from_arrays(arrays, names=[*[f.name for f in fields], *new])

    return df.mapInArrow(run, schema)


def listed(spans: list[dict] | None) -> list[Span]:
    return [(s["start"], s["end"], s["label"]) for s in spans or []]


def told(spans: list[Span]) -> list[dict]:
    return [{"start": a, "end": b, "label": x} for a, b, x in spans]


def claimed(spans: list[Span]) -> list[Span]:
    """Those that overlap none before them, in text order."""
    taken: list[Span] = []
    for s in spans:
        at = bisect_left(taken, (s[1],))  # the first that starts at this one's end or behind it
        if at == 0 or taken[at - 1][1] <= s[0]:
            insort(taken, s)
    return taken


class Ordered:
    """Spans by their starts, with the farthest end so far, so that the ones that overlap another are found side by side."""

    def __init__(self, spans: list[Span]) -> None:
        self.by_start = sorted((a, b, i) for i, (a, b, _) in enumerate(spans))
        self.starts, self.far, most = [a for a, _, _ in self.by_start], [], 0
        for _, b, _ in self.by_start:
            most = max(most, b)
            self.far.append(most)

    def overlapping(self, start: int, end: int) -> Iterator[int]:
        """The numbers of the spans that share a character with start..end; spans of no length overlap what holds them."""
        for k in range(bisect_right(self.far, start), bisect_left(self.starts, end)):
            if self.by_start[k][1] > start:
                yield self.by_start[k][2]


def pairs(gold: list[Span], predicted: list[Span]) -> list[tuple[int, int, int]]:
    """(kind, predicted number, gold number), each span in one pair at most: equal ones (0) first, then those of equal bounds (1),
    those that overlap and share a label (2), those that overlap (3), of a kind by number."""
    out, used_p, used_g = [], [False] * len(predicted), [False] * len(gold)

    def match(kind: int, candidates: Callable[[Span], Iterator[int]]) -> None:
        for i, p in enumerate(predicted):
            if not used_p[i]:
                g = min((g for g in candidates(p) if not used_g[g]), default=None)
                if g is not None:
                    used_p[i] = used_g[g] = True
                    out.append((kind, i, g))

    def queued(key: Callable[[Span], tuple]) -> Callable[[Span], Iterator[int]]:
        waiting: dict[tuple, list[int]] = {}
        for g in range(len(gold) - 1, -1, -1):
            waiting.setdefault(key(gold[g]), []).append(g)

        def first(p: Span) -> Iterator[int]:
            line = waiting.get(key(p), [])
            while line and used_g[line[-1]]:
                line.pop()
            return iter(line[-1:])

        return first

    match(0, queued(lambda s: s))
    match(1, queued(lambda s: s[:2]))
    order = Ordered(gold)
    match(2, lambda p: (g for g in order.overlapping(p[0], p[1]) if gold[g][2] == p[2]))
    match(3, lambda p: order.overlapping(p[0], p[1]))
    return out


def relaxed_hits(gold: list[Span], predicted: list[Span]) -> int:
    """How many predicted spans, in order, overlap a gold span of their label that none took before."""
    order, used, hits = Ordered(gold), [False] * len(gold), 0
    for p in predicted:
        g = min((g for g in order.overlapping(p[0], p[1]) if gold[g][2] == p[2] and not used[g]), default=None)
        if g is not None:
            used[g] = True
            hits += 1
    return hits


def strict_hits(gold: list[Span], predicted: list[Span]) -> int:
    """How many different spans both sides hold."""
    return len(set(gold) & set(predicted))


class Union:
    """The characters in any of the spans, as intervals that don't touch, and how many lie before each."""

    def __init__(self, spans: list[Span]) -> None:
        self.begins: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(s for s in spans if s[1] > s[0]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.begins.append(a)
                self.ends.append(b)
        self.upto = [0]
        for a, b in zip(self.begins, self.ends):
            self.upto.append(self.upto[-1] + b - a)

    def before(self, at: int) -> int:
        """Characters of the union before a place."""
        k = bisect_right(self.begins, at)
        return self.upto[k] - (max(0, self.ends[k - 1] - at) if k else 0)

    def inside(self, start: int, end: int) -> int:
        return self.before(end) - self.before(start) if end > start else 0

    def shared(self, other: Union) -> int:
        return sum(other.inside(a, b) for a, b in zip(self.begins, self.ends))

    @property
    def size(self) -> int:
        return self.upto[-1]


def coverage(gold: list[Span], predicted: list[Span]) -> tuple[int, int]:
    """(gold spans not fully covered, gold spans not covered at all) by spans of any label."""
    union = Union(predicted)
    covered = [union.inside(a, b) for a, b, _ in gold]
    return sum(c < max(0, b - a) for c, (a, b, _) in zip(covered, gold)), sum(c == 0 for c in covered)


#: What Java's \\s takes with UNICODE_CHARACTER_CLASS.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BREAKS = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
LABEL = re.compile("_*[A-Z][A-Z_]*")


def lines(text: str, spans: list[Span]) -> str:
    """`LABEL: value` lines in text order."""
    return "\n".join(f"{x}: {text[a:b]}" for a, b, x in sorted(spans))


def parsed(output: str) -> list[tuple[str, str]]:
    """The (label, value) pairs of `LABEL: value` lines."""
    found = [line.partition(":") for line in BREAKS.split(output)]
    each = [(label.strip(WHITE), value.strip(WHITE)) for label, colon, value in found if colon]
    return [(label, value) for label, value in each if LABEL.fullmatch(label)]


def placed(text: str, pairs: list[tuple[str, str]]) -> list[Span]:
    """Each non-empty value that has a place at its first occurrence that overlaps none placed before, in text order. What
    lies before a value's last place is taken for good, so its next search starts there."""
    out: list[Span] = []
    last: dict[str, int] = {}
    for label, value in pairs:
        if not value:
            continue
        at = text.find(value, last.get(value, 0)) if last.get(value, 0) >= 0 else -1
        while at >= 0:
            k = bisect_left(out, (at + len(value),)) - 1  # the last that starts before this one's end
            if k < 0 or out[k][1] <= at:
                break
            at = text.find(value, out[k][1])
        last[value] = at
        if at >= 0:
            insort(out, (at, at + len(value), label))
    return out


def guarded(text: str, prediction: str, detected: list[Span], labels: frozenset[str]) -> str:
    """The prediction with a line for each detected span of these labels that no placed span overlaps."""
    order = Ordered(placed(text, parsed(prediction)))
    extra = [s for s in detected if s[2] in labels and next(order.overlapping(s[0], s[1]), None) is None]
    values = [(x, text[a:b].strip(" ")) for a, b, x in extra]
    own = [prediction.rstrip("\n")] if prediction.strip(WHITE) else []
    return "\n".join([*own, *(f"{x}: {value}" for x, value in values if value)])


# ---------------------------------------------------------------- columns of frames


def with_matches(df: DataFrame, text: str, patterns: list[tuple[str, str, str]], out: str) -> DataFrame:
    """`df` with the spans of all patterns' matches, earlier patterns and then earlier matches first, that overlap none claimed
    before. patterns: (label, pattern, a plain pattern that any text with a match has a match of, too)."""
    compiled = [(label, regex.compile(p), need) for label, p, need in patterns]
    needs = {need: re.compile(need) for _, _, need in patterns}

    def make(value: str | None) -> dict:
        if value is None:
            return {out: None}
        there = {need for need, p in needs.items() if p.search(value)}
        found = [(m.start(), m.end(), label) for label, p, need in compiled if need in there for m in p.finditer(value)]
        return {out: told(claimed(found))}

    return mapped(df, [text], make, {out: SPANS})


def with_pairs(df: DataFrame, gold: str, predicted: str, out: str = "pairs") -> DataFrame:
    """`df` with the pairs of a text, in the order in which they are made."""
    make = lambda g, p: {out: [dict(zip(("kind", "p", "g"), x)) for x in pairs(listed(g), listed(p))]}
    return mapped(df, [gold, predicted], make, {out: PAIRS})


def with_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """`df` with the long columns _gold, _predicted (spans), _strict, _relaxed (hits), _partly and _wholly (unmasked)."""
    names = ["_gold", "_predicted", "_strict", "_relaxed", "_partly", "_wholly"]

    def make(g: list | None, p: list | None) -> dict:
        g, p = listed(g), listed(p)
        return dict(zip(names, (len(g), len(p), strict_hits(g, p), relaxed_hits(g, p), *coverage(g, p))))

    return mapped(df, [gold, predicted], make, {n: LongType() for n in names})


def with_leaks(df: DataFrame, gold: str, predicted: str, inside: list[str], no_mask: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the long columns _spans (gold ones in scope), _partly, _wholly (of these unmasked), _bounds (with a prediction of
    their bounds), _right (and of their label), _masked (characters) and _personal (of these in gold spans but for the
    labels in no_mask)."""
    names = ["_spans", "_partly", "_wholly", "_bounds", "_right", "_masked", "_personal"]
    scope = frozenset(inside)

    def make(g: list | None, p: list | None) -> dict:
        g, p = listed(g), listed(p)
        mine, own, bounds = [s for s in g if s[2] in scope], set(p), {s[:2] for s in p}
        masked, personal = Union(p), Union([s for s in g if s[2] not in no_mask])
        counts = (len(mine), *coverage(mine, p), sum(s[:2] in bounds for s in mine), sum(s in own for s in mine), masked.size, masked.shared(personal))
        return dict(zip(names, counts))

    return mapped(df, [gold, predicted], make, {n: LongType() for n in names})


def with_guard(df: DataFrame, text: str, predicted: str, detected: str, labels: list[str], out: str) -> DataFrame:
    """`df` with the lines of the predicted spans under the guard of the detected ones. A null text has null."""
    wanted = frozenset(labels)
    make = lambda t, p, d: {out: None if t is None or p is None or d is None else guarded(t, lines(t, listed(p)), listed(d), wanted)}
    return mapped(df, [text, predicted, detected], make, {out: StringType()})
