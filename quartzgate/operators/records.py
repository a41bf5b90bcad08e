"""Scored records: component scores, success rules, failure buckets, joins of two arms, relabelling and live grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from . import quantiles

# Urgency labels, and the prompt of each task with its text.
URGENCIES = ("low", "medium", "high")
PROMPTS = {
    "intent": "Classify the request into one label.\n\nRequest: {text}\nLabel:",
    "urgency": "How urgent is the ticket: low, medium or high?\n\nTicket: {text}\nUrgency:",
    "pii": "List the personal data in the text, one LABEL: value per line.\n\nText: {text}\nLines:",
    "drafting": "Reply to the customer.\n\nRequest: {text}\nReply:",
}


def prompt(task: Column, text: Column) -> Column:
    made = None
    for name, template in PROMPTS.items():
        before, after = template.split("{text}")
        here = F.concat(F.lit(before), text, F.lit(after))
        made = F.when(task == name, here) if made is None else made.when(task == name, here)
    return made


def router_text(task: Column, text: Column) -> Column:
    return F.concat(F.lit("task: "), task, F.lit(" | "), text)


def judge_text(request: Column, reply: Column) -> Column:
    return F.concat(F.lit("REQUEST:\n"), request, F.lit("\n\nREPLY:\n"), reply)


def scaled(score: Column) -> Column:
    """Grades 1 to 5 around 0."""
    return (score - 3) / 2


def unscaled(prediction: Column) -> Column:
    return prediction * 2 + 3


def components(task: Column, text: Column, gold: Column, prediction: Column) -> Column:
    """STRUCT<exact, tp, gold_spans, pred_spans, proxy>: what the task's score is made of; other tasks' fields are null."""
    g, p = S.place(text, S.parse_output(gold)), S.place(text, S.parse_output(prediction))
    label = task.isin("intent", "urgency")
    return F.struct(
        F.when(label, T.first_line_matches(prediction, gold)).alias("exact"), F.when(task == "pii", S.strict_hits(g, p)).alias("tp"),
        F.when(task == "pii", F.size(g)).alias("gold_spans"), F.when(task == "pii", F.size(p)).alias("pred_spans"),
        F.when(task == "drafting", T.token_f1(prediction, gold)).alias("proxy"),
    )


def median_draft(scored: DataFrame) -> float | None:
    """The median overlap of the drafts."""
    return quantiles.exact(scored.where("task = 'drafting'"), "proxy", [0.5]).first()["q"][0]


def labelled(scored: DataFrame, cut: float | None = None) -> DataFrame:
    """`scored` (task, exact, tp, gold_spans, pred_spans, proxy) with success, label_rule, label_is_proxy. A draft succeeds
    where its overlap is above 0 and reaches the cut, the median of this arm unless given. A document
    without any span, gold or predicted, is no success."""
    if cut is None:
        cut = median_draft(scored)
    task = F.col("task")
    all_right = (F.col("tp") > 0) & (F.col("tp") == F.col("gold_spans")) & (F.col("tp") == F.col("pred_spans"))
    draft = (F.col("proxy") > 0) & (F.col("proxy") >= F.lit(cut).cast("double"))
    return scored.select(
        "*", F.when(task == "pii", all_right).when(task == "drafting", draft).otherwise(F.col("exact") == 1).alias("success"),
        F.when(task == "pii", "span_f1").when(task == "drafting", "proxy_median").otherwise("exact").alias("label_rule"), (task == "drafting").alias("label_is_proxy"),
    )


def failure_type() -> Column:
    """The bucket of a failed record, null for a success: how it failed, in this order."""
    missed, invented = F.col("tp") < F.col("gold_spans"), F.col("tp") < F.col("pred_spans")
    f1 = lambda hits: F.coalesce(F.try_divide(2.0 * F.col(hits), F.col("gold_spans") + F.col("pred_spans")), F.lit(0.0))
    return (
        F.when(F.col("success"), None)
        .when(F.col("task").isin("intent", "urgency"), "wrong_label")
        .when(F.col("task") == "drafting", "off_reference")
        .when(F.coalesce(F.col("pred_spans"), F.lit(0)) == 0, "no_output")
        .when(f1("relaxed") > f1("tp") + 0.01, "boundary")
        .when(missed & ~invented, "missed")
        .when(invented & ~missed, "invented")
        .otherwise("mixed")
    )


def malformed(task: Column, prediction: Column, vocabulary: list[str]) -> Column:
    """Why an answer can't be served: label, pii or reply; null where it can."""
    blank = F.rlike(prediction, F.lit(r"(?U)^\s*$"))
    lines = F.size(F.filter(F.split(prediction, "\n"), lambda x: F.length(T.strip(x)) > 0))
    return (
        F.when(task.isin("intent", "urgency") & ~T.first_line(prediction).isin(*vocabulary), "label")
        .when((task == "pii") & ~blank & (F.size(S.parse_output(prediction)) < lines), "pii")
        .when((task == "drafting") & blank, "reply")
    )


def two_arms(local: DataFrame, frontier: DataFrame) -> DataFrame:
    """Both arms' records joined one to one, drafts of both judged by the local arm's cut: `success` and
    `frontier_success`. Frontier records that are missing leave null."""
    cut = median_draft(local)
    theirs = labelled(frontier, cut).select("pair_id", F.col("success").alias("frontier_success"))
    return labelled(local, cut).join(theirs, "pair_id", "left")


def relabelled(records: DataFrame, grades: DataFrame, least: int = 4) -> DataFrame:
    """Drafts succeed where their grade reaches `least`; the rule's label stays as proxy_success. An ungraded draft is an
    error. grades: (pair_id, grade), the first per pair."""
    joined = records.join(grades, "pair_id", "left")
    draft = F.col("task") == "drafting"
    missing = joined.where(draft & F.col("grade").isNull()).count()
    if missing:
        raise ValueError(f"{missing} drafts have no grade")
    out = joined.withColumn("proxy_success", F.when(draft, F.col("success")))
    return out.withColumn("success", F.when(draft, F.col("grade") >= least).otherwise(F.col("success"))).drop("grade")


def rescue(local: DataFrame, frontier: DataFrame) -> DataFrame:
    """(pair_id, rescue): the frontier succeeds where the local arm fails. Labels recorded twice must agree."""
    joined = local.join(frontier.select("pair_id", "frontier_success", F.col("success").alias("_again")), "pair_id")
    if not joined.where("not (success <=> _again)").isEmpty():
        raise ValueError("success differs between the two records")
    return joined.select("pair_id", (F.col("frontier_success") & ~F.col("success")).alias("rescue"))


def design(signals: DataFrame, tasks: list[str]) -> DataFrame:
    """`signals` (task, mean_logprob, min_logprob, n_tokens, finish_reason) with `features`: per task a constant and four
    signals, zeros for other tasks. A null signal is an error."""
    if not signals.where("mean_logprob is null or min_logprob is null or n_tokens is null").isEmpty():
        raise ValueError("a signal is null")
    one = [F.lit(1.0), F.col("mean_logprob"), F.col("min_logprob"), F.log1p("n_tokens"), (F.col("finish_reason") == "length").cast("double")]
    return signals.withColumn("features", F.array(*[F.when(F.col("task") == t, x).otherwise(0.0) for t in tasks for x in one]))


def every_source_fails(results: DataFrame) -> DataFrame:
    """results: (row, source, ok). The rows that no source gets right."""
    return results.groupBy("row").agg(F.bool_or("ok").alias("any")).where("not any").select("row")


def identical_adapters(outputs: DataFrame) -> DataFrame:
    """outputs: (adapter, probe, text). Rows (a, b): adapters that answer every probe alike. Probes and adapters are few."""
    a = outputs.select("probe", F.col("adapter").alias("a"), F.col("text").alias("x"))
    b = outputs.select("probe", F.col("adapter").alias("b"), F.col("text").alias("y"))
    return a.join(b, "probe").where("a < b").groupBy("a", "b").agg(F.bool_and(F.col("x") == F.col("y")).alias("same")).where("same").select("a", "b")


def false_positives(outputs: DataFrame) -> DataFrame:
    """outputs: (source, text, output) on texts without personal data. Per source and, with a null source, over all: the
    share of texts with any line, and of those with a grounded and an invented value."""
    pairs = S.parse_output(F.col("output"))
    each = outputs.withColumn("_p", pairs).select(
        "source", (F.size("_p") > 0).alias("any"), F.exists("_p", lambda p: T.grounded(F.col("text"), p["value"])).alias("grounded"),
        F.exists("_p", lambda p: ~T.grounded(F.col("text"), p["value"])).alias("invented"),
    )
    rate = lambda c: F.avg(F.col(c).cast("int")).alias(f"{c}_rate")
    return each.rollup("source").agg(F.count("*").alias("texts"), rate("any"), rate("grounded"), rate("invented"))


def spans_of_template(source: str, masked: str) -> tuple[list[tuple[int, int, str]], bool]:
    """The spans that placeholders such as [CITY_1] stand for, by aligning the literal text between them; and whether all
    of it aligned. A row function, for mapInPandas or tests."""
    import re

    parts = re.split(r"\[([A-Z]+)(?:_\d+)?\]", masked)
    at, out = 0, []
    if not source.startswith(parts[0]):
        return [], False
    at = len(parts[0])
    for label, literal in zip(parts[1::2], parts[2::2]):
        end = len(source) if not literal else source.find(literal, at)
        if end < 0:
            return out, False
        out.append((at, end, label))
        at = end + len(literal)
    return out, at == len(source)


def sentences(text: Column) -> Column:
    """Sentences, from a character that isn't white space to closing marks before white space or the end."""
    return F.regexp_extract_all(text, F.lit(r"(?sU)(\S.*?(?:[.!?]+(?=\s|$)|$))"), 1)


def event_times(lines: list[tuple[float, str]]) -> dict:
    """What a stream of server-sent events tells: seconds to the first text, to the end, and tokens. lines: (seconds since
    the request, line)."""
    import json

    first = tokens = None
    last = 0.0
    for at, line in lines:
        if not line.startswith("data:") or line[5:].strip() == "[DONE]":
            continue
        last = at
        event = json.loads(line[5:])
        if first is None and any(c.get("text") or (c.get("delta") or {}).get("content") for c in event.get("choices", [])):
            first = at
        tokens = (event.get("usage") or {}).get("completion_tokens", tokens)
    per = None if first is None or not tokens or tokens < 2 else (last - first) * 1000 / (tokens - 1)
    return {"ttft_ms": None if first is None else first * 1000, "total_ms": last * 1000, "tokens": tokens, "tpot_ms": per}
