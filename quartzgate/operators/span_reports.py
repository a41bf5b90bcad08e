"""What span errors and leaks come to: causes by document, labels, confusions, bounds, success by size, and leaks by scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles, sweep

#: Edges of the bins of a document's gold spans, and their names.
SPAN_BINS = ((2, "1-2"), (5, "3-5"), (9, "6-9"), (None, "10+"))
QUARTERS = ("shortest quarter", "second", "third", "longest quarter")
# The kinds of errors that make a document fail, and labels that are told apart least.
CAUSES = ["label", "boundary", "boundary_and_label", "spurious", "missed"]
NAMES = ["GIVENNAME", "SURNAME"]
ID_NUMBERS = ["DRIVERLICENSENUM", "IDCARDNUM", "PASSPORTNUM", "SOCIALNUM", "TAXNUM"]


def documents(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs: (doc, text, gold); rows: as pii.errors gives. Rows (doc, gold_spans, chars, causes): the kinds of errors for which
    each document fails, none where it doesn't: values that are invented or repeated fail nothing."""
    causes = rows.where(F.col("kind").isin(CAUSES)).groupBy("doc").agg(F.sort_array(F.collect_set("kind")).alias("causes"))
    base = docs.select(F.col("doc").cast("long").alias("doc"), F.size("gold").alias("gold_spans"), F.length("text").alias("chars"))
    return base.join(causes, "doc", "left").withColumn("causes", F.coalesce("causes", F.array().cast("array<string>")))


def totals(outcomes: DataFrame) -> DataFrame:
    """One row: documents, right (without an error), success_rate, failed, failed_with_several_causes."""
    right = F.size("causes") == 0
    return outcomes.agg(
        F.count("*").alias("documents"), F.count_if(right).alias("right"), F.avg(right.cast("int")).alias("success_rate"), F.count_if(~right).alias("failed"),
        F.count_if(F.size("causes") > 1).alias("failed_with_several_causes"),
    )


def by_cause(outcomes: DataFrame) -> DataFrame:
    """Rows (cause, any, single): documents that fail by a cause, and that fail by it alone."""
    each = outcomes.select(F.explode("causes").alias("cause"), (F.size("causes") == 1).alias("_one"))
    return each.groupBy("cause").agg(F.count("*").alias("any"), F.count_if("_one").alias("single"))


def by_label(rows: DataFrame) -> DataFrame:
    """Rows (label, gold, exact, recall, label_errors, boundary, boundary_and_label, missed) over gold spans."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return rows.where("gold_label is not null").groupBy(F.col("gold_label").alias("label")).agg(
        F.count("*").alias("gold"), kind("exact").alias("exact"), (kind("exact") / F.count("*")).alias("recall"), kind("label").alias("label_errors"),
        kind("boundary").alias("boundary"), kind("boundary_and_label").alias("boundary_and_label"), kind("missed").alias("missed"),
    )


def confusions(rows: DataFrame, most: int = 12) -> DataFrame:
    """Rows (gold, predicted, n): the labels taken for others, the `most` commonest pairs, ties by name."""
    wrong = rows.where("kind in ('label', 'boundary_and_label')")
    counts = wrong.groupBy(F.col("gold_label").alias("gold"), F.col("pred_label").alias("predicted")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "gold", "predicted").limit(most)


def bounds_and_groups(rows: DataFrame) -> DataFrame:
    """One row: boundary errors that extend and that shorten the gold value, those on names, and label errors within identity
    numbers and between gender and sex."""
    bound = F.col("kind") == "boundary"
    longer = F.length("pred_value") - F.length("gold_value")
    confused = F.col("kind").isin("label", "boundary_and_label")
    g, p = F.col("gold_label"), F.col("pred_label")
    pair = ((g == "GENDER") & (p == "SEX")) | ((g == "SEX") & (p == "GENDER"))
    return rows.agg(
        F.count_if(bound & (longer > 0)).alias("extends"), F.count_if(bound & (longer < 0)).alias("shortens"), F.count_if(bound & g.isin(NAMES)).alias("on_names"),
        F.count_if(confused & g.isin(ID_NUMBERS) & p.isin(ID_NUMBERS)).alias("within_id_numbers"), F.count_if(confused & pair).alias("gender_sex"),
    )


def commonest(rows: DataFrame, kind: str, most: int = 10) -> DataFrame:
    """Rows (label, value, n): what is predicted in error of a kind, the commonest first, ties by name."""
    counts = rows.where(F.col("kind") == kind).groupBy(F.col("pred_label").alias("label"), F.col("pred_value").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "label", "value").limit(most)


def success_by_size(outcomes: DataFrame) -> DataFrame:
    """Rows (measure, bin, documents, success): by the number of gold spans (documents without any aside) and by quarter of the
    lengths of all texts; a quarter whose bounds coincide is one with the next."""
    spans = None
    for edge, name in reversed(SPAN_BINS):
        spans = F.lit(name) if edge is None else F.when(F.col("gold_spans") <= edge, name).otherwise(spans)
    edges = quantiles.exact(outcomes, "chars", [0.25, 0.5, 0.75]).select(F.col("q").alias("_q"))  # one row
    placed = outcomes.crossJoin(F.broadcast(edges))
    quarter = F.size(F.filter("_q", lambda e: e < F.col("chars")))
    length = F.element_at(F.array(*map(F.lit, QUARTERS)), quarter + 1)
    each = F.array(
        F.struct(F.lit("gold_spans").alias("measure"), F.when(F.col("gold_spans") > 0, spans).alias("bin")), F.struct(F.lit("chars").alias("measure"), length.alias("bin"))
    )
    long = placed.select(F.explode(each).alias("_b"), (F.size("causes") == 0).cast("int").alias("_r")).where("_b.bin is not null")
    return long.groupBy("_b.measure", "_b.bin").agg(F.count("*").alias("documents"), F.avg("_r").alias("success"))


# ---------------------------------------------------------------- leaks


def with_scopes(df: DataFrame, gold: str, predicted: str, scope: dict[str, str]) -> DataFrame:
    """`df` with, for each text, the columns of scoped_leaks(): how redaction by the predicted spans leaves gold spans that are in or
    out of scope, or need no mask (labels that `scope` lacks)."""
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    names = ["_masked", "_on_personal", "_on_no_mask", "_exact", "_partly_in"]
    counts = StructType([StructField("scope", StringType()), StructField("label", StringType()), *[StructField(n, LongType()) for n in ("spans", "partly", "wholly", "exact")]])

    def make(g: list | None, p: list | None) -> dict:
        g, p = sweep.listed(g), sweep.listed(p)
        bounds, found = {s[:2] for s in p}, {}
        for s in g:
            where = scope.get(s[2], "no_mask")
            if where != "no_mask":
                found.setdefault((where, s[2]), []).append(s)
        rows = []
        for (where, label), spans in found.items():
            partly, wholly = sweep.coverage(spans, p)
            rows.append({"scope": where, "label": label, "spans": len(spans), "partly": partly, "wholly": wholly, "exact": sum(s[:2] in bounds for s in spans)})
        personal = sweep.Union([s for s in g if scope.get(s[2], "no_mask") != "no_mask"])
        every, masked = sweep.Union(g), sweep.Union(p)
        on_personal = masked.shared(personal)
        mine = [r for r in rows if r["scope"] == "in"]
        totals = (masked.size, on_personal, masked.shared(every) - on_personal, sum(r["exact"] for r in mine), sum(r["partly"] for r in mine))
        return {"_labels": rows, **dict(zip(names, totals))}

    return sweep.mapped(df, [gold, predicted], make, {"_labels": ArrayType(counts), **{n: LongType() for n in names}})


def leaks_by_label(scoped: DataFrame) -> DataFrame:
    """Rows (scope, label, spans, partly_unmasked, wholly_unmasked) of with_scopes()."""
    each = scoped.select(F.explode("_labels").alias("_l")).select("_l.*")
    return each.groupBy("scope", "label").agg(F.sum("spans").alias("spans"), F.sum("partly").alias("partly_unmasked"), F.sum("wholly").alias("wholly_unmasked"))


def leak_report(scoped: DataFrame, escalated: Column) -> DataFrame:
    """One row of with_scopes(): texts, fully_masked (share without a leak in scope), spans in scope with the shares left in part and
    altogether, the share out of scope left altogether, the shares of masked characters on personal data and on mentions
    that need no mask, the share of spans in scope that a prediction bounds exactly, the share escalated, and the texts
    with a leak, also among the escalated."""
    of = lambda where, what: F.aggregate("_labels", F.lit(0).cast("long"), lambda t, x: t + F.when(x["scope"] == where, x[what]).otherwise(0))
    rate = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    leaky, up = F.col("_partly_in") > 0, F.coalesce(escalated, F.lit(False))
    return scoped.agg(
        F.count("*").alias("texts"), F.avg((~leaky).cast("int")).alias("fully_masked"), F.sum(of("in", "spans")).alias("in_scope_spans"),
        rate(of("in", "partly"), of("in", "spans")).alias("in_scope_partly_unmasked"), rate(of("in", "wholly"), of("in", "spans")).alias("in_scope_wholly_unmasked"),
        rate(of("out", "wholly"), of("out", "spans")).alias("out_of_scope_wholly_unmasked"), rate(F.col("_on_personal"), F.col("_masked")).alias("masked_on_personal"),
        rate(F.col("_on_no_mask"), F.col("_masked")).alias("masked_on_no_mask"), rate(F.col("_exact"), of("in", "spans")).alias("in_scope_boundary_exact"),
        F.avg(up.cast("int")).alias("escalated"), F.count_if(leaky).alias("texts_with_a_leak"), F.count_if(leaky & up).alias("texts_with_a_leak_escalated"),
    )
