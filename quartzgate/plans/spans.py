"""Text and span queries: the detector, scores, the guard, errors and screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import session
from ..functions import spans as S
from ..functions import text as T
from ..operators import pii, span_reports
from ..sources.tables import spread, table
from .registry import query


def detected(spark, d):
    """(doc, text, gold): the detector's spans of documents, as gold."""
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return pii.detected(docs)


def scored(spark, d):
    """With a prediction made from gold: every third span is lost, another third ends one character early."""
    kept = F.filter(F.col("gold"), lambda s: s["start"] % 3 != 0)
    moved = F.transform(kept, lambda s: S.span(s["start"], F.when(s["start"] % 3 == 1, s["end"] - 1).otherwise(s["end"]), s["label"]))
    return detected(spark, d).withColumn("predicted", moved)


@query()
def pii_regex_spans(spark, d):
    return detected(spark, d).select("doc", F.explode("gold").alias("s")).select("doc", "s.start", "s.end", "s.label")


@query()
def span_scores(spark, d):
    return pii.span_report(scored(spark, d), "gold", "predicted")


@query()
def span_scores_grouped(spark, d):
    g = lambda c: S.grouped(F.col("text"), F.col(c))
    return pii.span_report(scored(spark, d).select("doc", g("gold").alias("gold"), g("predicted").alias("predicted")), "gold", "predicted")


@query()
def span_labels(spark, d):
    return pii.label_report(scored(spark, d), "gold", "predicted")


@query()
def span_errors(spark, d):
    lost = F.array().cast("array<struct<label:string,value:string,why:string>>")
    return pii.errors(scored(spark, d).withColumn("unplaced", lost)).groupBy("kind").agg(F.count("*").alias("n"))


@query()
def guard_additions(spark, d):
    return pii.guarded(scored(spark, d), "text", "predicted", "gold").select("doc", "guarded")


@query()
def cue_relabels(spark, d):
    s = detected(spark, d)
    return s.select("doc", F.to_json(pii.relabelled(F.col("text"), F.col("gold"))).alias("spans"))


@query()
def redacted_texts(spark, d):
    s = detected(spark, d)
    return s.select("doc", S.redact(F.col("text"), F.col("gold"), {"EMAIL": "<mail>"}, "<removed>").alias("redacted"), S.remove(F.col("text"), F.col("gold")).alias("blind"))


@query()
def text_paragraphs(spark, d):
    s = detected(spark, d).select("doc", F.explode(S.paragraphs(F.col("text"), F.col("gold"))).alias("p"))
    return s.select("doc", "p.start", "p.text", F.size("p.spans").alias("spans"))


@query()
def span_error_summary(spark, d):
    lost = F.array().cast("array<struct<label:string,value:string,why:string>>")
    return pii.error_summary(pii.errors(scored(spark, d).withColumn("unplaced", lost)))


@query()
def span_error_check(spark, d):
    return pii.exact_equals_strict(scored(spark, d))


@query()
def leaks_per_text(spark, d):
    return pii.leaks_per_text(scored(spark, d), "gold", "predicted").select("doc", "partly", "wholly")


@query()
def leak_score(spark, d):
    return pii.leak_score(scored(spark, d), "gold", "predicted", ["EMAIL", "CREDITCARDNUMBER", "TELEPHONENUM"])


@query()
def cue_accuracy(spark, d):
    return pii.cue_accuracy(detected(spark, d), "gold")


@query()
def relabelling_effect(spark, d):
    return pii.relabelling_effect(scored(spark, d), "gold", "predicted")


def _errors(spark, d):
    lost = F.array().cast("array<struct<label:string,value:string,why:string>>")
    docs = session.materialize(scored(spark, d).withColumn("unplaced", lost), "span-errors")
    return docs, session.materialize(pii.errors(docs), "span-error-rows")


@query()
def error_totals(spark, d):
    return span_reports.totals(span_reports.documents(*_errors(spark, d)))


@query()
def error_causes(spark, d):
    return span_reports.by_cause(span_reports.documents(*_errors(spark, d)))


@query()
def error_labels(spark, d):
    return span_reports.by_label(_errors(spark, d)[1])


@query()
def error_confusions(spark, d):
    return span_reports.confusions(_errors(spark, d)[1])


@query()
def error_bounds(spark, d):
    return span_reports.bounds_and_groups(_errors(spark, d)[1])


@query()
def success_by_size(spark, d):
    return span_reports.success_by_size(span_reports.documents(*_errors(spark, d)))


SCOPE = {"EMAIL": "in", "CREDITCARDNUMBER": "in", "TELEPHONENUM": "in", "DATE": "out", "ZIPCODE": "out"}


def _scoped(spark, d):
    return span_reports.with_scopes(scored(spark, d), "gold", "predicted", SCOPE)


@query()
def leak_report(spark, d):
    return span_reports.leak_report(_scoped(spark, d), F.length("text") % 3 == 0)


@query()
def leaks_by_label(spark, d):
    return span_reports.leaks_by_label(_scoped(spark, d))


SCREEN = r"""WITH t AS (SELECT conv_id, turn, text, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM conversations),
parts AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(s, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1))) AS p FROM t),
w AS (SELECT conv_id, turn, bool_or(len(list_filter(regexp_extract_all(p, '[A-Za-z][A-Za-z''\-]*')[2:], lambda x: regexp_matches(x, '^[A-Z]') AND x <> 'I' AND x <> upper(x))) > 0) AS named FROM parts GROUP BY ALL)
SELECT t.conv_id, t.turn, NOT (regexp_matches(text, '[0-9]|@|\{\{|<') OR regexp_matches(text, '(?i)\b(mr|mrs|ms|miss|dr|sir|madam|mister|prof)\b')
  OR regexp_matches(text, '(?i)\b(he|she|him|her|his|hers|male|female|man|woman|boy|girl|husband|wife|son|daughter|mother|father|mom|dad|brother|sister)\b') OR named) AS free
FROM t JOIN w USING (conv_id, turn)"""


@query(SCREEN)
def pii_free_turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.pii_free(F.col("text")).alias("free"))


@query(r"""SELECT item_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words FROM benchmark""")
def word_counts(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query(r"""SELECT item_id, trim(split_part(trim(text, ' ' || chr(10)), chr(10), 1)) AS line FROM benchmark""")
def first_lines(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.first_line(F.col("text")).alias("line"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS chars FROM pages""")
def page_titles(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.length(F.regexp_replace(html, "<[^>]*>", " ")).cast("long").alias("chars")
    )
