"""Labelled spans as ARRAY<STRUCT<start, end, label>> with half-open code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,label:string>>"
PAIRS = "array<struct<label:string,value:string>>"
#: Labels that a grouped score counts as one.
GROUPED = {
    "GENDER": "SEX_OR_GENDER",
    "SEX": "SEX_OR_GENDER",
    "DRIVERLICENSENUM": "ID_NUMBER",
    "IDCARDNUM": "ID_NUMBER",
    "PASSPORTNUM": "ID_NUMBER",
    "SOCIALNUM": "ID_NUMBER",
    "TAXNUM": "ID_NUMBER",
    "GIVENNAME": "NAME",
    "SURNAME": "NAME",
}


def empty() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, label: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def parse_output(text: Column) -> Column:
    """The (label, value) pairs of `LABEL: value` lines; a label is in capitals and underscores with a letter."""
    lines = F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")

    def pair(line: Column) -> Column:
        at = F.instr(line, ":")
        trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        label = F.when(at > 0, trim(F.substring(line, F.lit(1), at - 1))).otherwise("")
        value = F.when(at > 0, trim(F.substr(line, at + 1))).otherwise("")
        return F.struct(label.alias("label"), value.alias("value"))

    return F.filter(F.transform(lines, pair), lambda p: F.rlike(p["label"], F.lit("^_*[A-Z][A-Z_]*$")))


def locate(text: Column, pairs: Column) -> Column:
    """STRUCT<placed, unplaced>: each non-empty value at its first occurrence that overlaps none placed before;
    what can't be placed is `repeated_value` where it occurs at all, else `invented`."""
    start = F.struct(empty().alias("placed"), F.array().cast("array<struct<label:string,value:string,why:string>>").alias("unplaced"))

    def free_place(v: Column, placed: Column) -> Column:
        """The first place from 1, or 0: from each span in the way the search goes on behind it."""
        return F.aggregate(
            F.array_sort(placed), F.position(v, text),
            lambda i, s: F.when((i > 0) & (s["start"] < i - 1 + F.length(v)) & (i - 1 < s["end"]), F.position(v, text, s["end"] + 1)).otherwise(i),
        )

    def step(state: Column, p: Column) -> Column:
        v = p["value"]
        first = free_place(v, state["placed"])
        at = F.when(first > 0, first - 1)
        placed = F.concat(state["placed"], F.array(span(at, at + F.length(v), p["label"])))
        why = F.when(F.contains(text, v), "repeated_value").otherwise("invented")
        lost = F.concat(state["unplaced"], F.array(F.struct(p["label"].alias("label"), v.alias("value"), why.alias("why"))))
        return (
            F.when(F.length(v) == 0, state)
            .when(at.isNotNull(), F.struct(placed.alias("placed"), state["unplaced"].alias("unplaced")))
            .otherwise(F.struct(state["placed"].alias("placed"), lost.alias("unplaced")))
        )

    return F.aggregate(pairs, start, step)


def place(text: Column, pairs: Column) -> Column:
    return locate(text, pairs)["placed"]


def matches(text: Column, pattern: str, label: str) -> Column:
    """The spans of all matches of a regular expression that never matches an empty string."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), empty().alias("out"))

    def step(s: Column, m: Column) -> Column:
        begin = s["at"] + F.length(F.get(gaps, s["k"]))
        end = begin + F.length(m)
        return F.struct(end.alias("at"), (s["k"] + 1).alias("k"), F.concat(s["out"], F.array(span(begin, end, F.lit(label)))).alias("out"))

    return F.when(F.size(found) == 0, empty()).otherwise(F.aggregate(found, state, step)["out"])


def claim(first: Column, more: Column) -> Column:
    """`first` and those of `more` that overlap nothing claimed so far."""
    return F.aggregate(
        more, first,
        lambda taken, s: F.when(F.exists(taken, lambda t: overlaps(t, s)), taken).otherwise(F.concat(taken, F.array(s))),
    )


def coverage(gold: Column, predicted: Column) -> Column:
    """STRUCT<partly, wholly>: gold spans not fully covered, and not covered at all, by spans of any label."""

    def covered(g: Column) -> Column:
        at = F.when(g["end"] > g["start"], F.sequence(g["start"], g["end"] - 1)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(at, lambda i: F.exists(predicted, lambda p: (p["start"] <= i) & (i < p["end"]))))

    partly = F.size(F.filter(gold, lambda g: covered(g) < g["end"] - g["start"]))
    wholly = F.size(F.filter(gold, lambda g: covered(g) == 0))
    return F.struct(partly.alias("partly"), wholly.alias("wholly"))


def characters(spans: Column) -> Column:
    """The distinct character positions in spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1))))


def strict_hits(gold: Column, predicted: Column) -> Column:
    """How many predicted spans equal a gold one, each gold span used once."""
    return F.size(F.array_intersect(gold, predicted))


def relaxed_hits(gold: Column, predicted: Column) -> Column:
    """How many predicted spans, in order, overlap a gold span of their label that none took before."""
    state = F.struct(gold.alias("left"), F.lit(0).alias("hits"))

    def step(s: Column, p: Column) -> Column:
        at = F.array_position(F.transform(s["left"], lambda g: (g["label"] == p["label"]) & overlaps(g, p)), True).cast("int")
        rest = F.concat(F.slice(s["left"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(s["left"], at + 1, F.size(s["left"])))
        return F.when(at > 0, F.struct(rest.alias("left"), (s["hits"] + 1).alias("hits"))).otherwise(s)

    return F.aggregate(predicted, state, step)["hits"]


def grouped(text: Column, spans: Column) -> Column:
    """Labels of a group as one, and name spans with only white space between them joined."""
    names = F.create_map(*[F.lit(x) for kv in GROUPED.items() for x in kv])
    mapped = F.array_sort(
        F.transform(spans, lambda s: span(s["start"], s["end"], F.coalesce(F.element_at(names, s["label"]), s["label"])))
    )

    def step(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        between = F.substring(text, last["end"] + 1, s["start"] - last["end"])
        joins = (F.size(out) > 0) & (s["label"] == "NAME") & (last["label"] == "NAME") & F.rlike(between, F.lit(r"(?U)^\s*$"))
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(span(last["start"], s["end"], s["label"])))
        return F.when(joins, joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(mapped, empty(), step)


def redact(text: Column, spans: Column, table: dict[str, str], default: str) -> Column:
    """Each span replaced by its label's surrogate, from the right."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    put = lambda t, s: F.concat(
        F.substring(t, F.lit(1), s["start"]), F.coalesce(F.element_at(names, s["label"]), F.lit(default)), F.substr(t, s["end"] + 1)
    )
    return F.aggregate(F.reverse(F.array_sort(spans)), text, put)


def remove(text: Column, spans: Column) -> Column:
    """The text without its spans, white space collapsed."""
    cut = F.aggregate(F.reverse(F.array_sort(spans)), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.substr(t, s["end"] + 1)))
    return F.trim(F.regexp_replace(cut, r"(?U)\s+", " "))


def to_lines(text: Column, spans: Column) -> Column:
    """`LABEL: value` lines in text order."""
    each = F.transform(F.array_sort(spans), lambda s: F.concat(s["label"], F.lit(": "), F.substring(text, s["start"] + 1, s["end"] - s["start"])))
    return F.array_join(each, "\n")


def paragraphs(text: Column, spans: Column) -> Column:
    """STRUCT<start, text, spans> for each run without line breaks that holds a character, its spans rebased."""
    lines = F.split(text, "\n", -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        here = F.array(F.struct(s["at"].alias("start"), line.alias("text")))
        return F.struct(
            (s["at"] + F.length(line) + 1).alias("at"),
            F.when(F.length(line) > 0, F.concat(s["out"], here)).otherwise(s["out"]).alias("out"),
        )

    def rebased(p: Column) -> Column:
        end = p["start"] + F.length(p["text"])
        inside = F.filter(spans, lambda s: (s["start"] >= p["start"]) & (s["end"] <= end))
        moved = F.transform(inside, lambda s: span(s["start"] - p["start"], s["end"] - p["start"], s["label"]))
        return F.struct(p["start"].alias("start"), p["text"].alias("text"), moved.alias("spans"))

    return F.transform(F.aggregate(lines, state, step)["out"], rebased)


def scope(label: Column, inside: list[str], outside: list[str]) -> Column:
    """in or out by label, else no_mask."""
    return F.when(label.isin(*inside), "in").when(label.isin(*outside), "out").otherwise("no_mask")


def target_lines(text: Column, spans: Column, names: dict[str, str]) -> Column:
    """`LABEL: value` lines in text order of the spans whose label has a name."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    known = F.filter(spans, lambda s: s["label"].isin(*names))
    return to_lines(text, F.transform(known, lambda s: span(s["start"], s["end"], F.element_at(table, s["label"]))))


def occurrences(text: Column, values: Column, least: int = 2) -> Column:
    """Spans of every occurrence of the values (label, value), case aside, that no span of an earlier value or place
    overlaps; in text order. Values under `least` characters have none."""

    def step(taken: Column, p: Column) -> Column:
        v = p["value"]
        # places are those of the text itself: its lower case may be longer
        pattern = F.concat(F.lit("(?iu)\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        found_texts = F.regexp_extract_all(text, pattern, F.lit(0))
        parts = F.split(text, pattern, -1)
        state = F.struct(F.lit(0).alias("at"), empty().alias("out"))

        def next_(s: Column, both: Column) -> Column:
            begin = (s["at"] + F.length(both["gap"])).cast("int")
            end = (begin + F.length(both["hit"])).cast("int")
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(span(begin, end, p["label"]))).alias("out"))

        gaps = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        found = F.aggregate(F.zip_with(gaps, found_texts, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))), state, next_)["out"]
        return F.when(F.length(v) >= least, claim(taken, found)).otherwise(taken)

    return F.array_sort(F.aggregate(values, empty(), step))
