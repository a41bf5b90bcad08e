"""Classification, ranking, agreement, bootstrap and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bootstrap, features, judging, metrics, models, overlap
from ..sources.tables import spread, table
from .base import GRADES, PAIRS, PREDICTIONS, TURNS, grades, pairs, predictions, turns
from .registry import query

P = f"WITH {PAIRS}, {PREDICTIONS}"
LABELS = f"""{P}, l AS (SELECT gold AS label FROM predictions UNION SELECT prediction FROM predictions),
each AS (SELECT label, count(*) FILTER (WHERE gold = label AND prediction = label) AS tp, count(*) FILTER (WHERE gold <> label AND prediction = label) AS fp,
  count(*) FILTER (WHERE gold = label AND prediction <> label) AS fn, count(*) FILTER (WHERE gold = label) AS support FROM l CROSS JOIN predictions GROUP BY label)"""


@query(f"{LABELS} SELECT * FROM each")
def label_counts(spark, d):
    return metrics.label_counts(predictions(spark, d), "gold", "prediction")


@query(f"""{LABELS}, f AS (SELECT *, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM each)
SELECT sum(support)::BIGINT AS n, sum(tp)::DOUBLE / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM f""")
def macro_f1(spark, d):
    return metrics.classification_report(predictions(spark, d), "gold", "prediction")


def _auc(keys: str) -> str:
    by = f"{keys}," if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""WITH {PAIRS}, e AS (SELECT {by} -mean_logprob AS s, count(*) AS c, sum((NOT success)::INT) AS pos FROM pairs GROUP BY {by} s),
u AS (SELECT *, sum(c) OVER w AS cum, sum(pos) OVER w AS cum_pos FROM e WINDOW w AS ({part} ORDER BY s DESC)),
t AS (SELECT {by} sum(c)::BIGINT AS n, sum(pos) AS p, sum((c - pos) * (cum_pos - pos) + 0.5e0 * (c - pos) * pos) AS above, sum(pos * cum_pos::DOUBLE / cum) AS step FROM u {group})
SELECT {by} n, p::DOUBLE / n AS base_rate, CASE WHEN p > 0 AND p < n THEN above / (p * (n - p)) END AS roc_auc,
CASE WHEN p > 0 AND p < n THEN step / p END AS average_precision FROM t"""


def _failures(spark, d):
    return pairs(spark, d).select("task", (-F.col("mean_logprob")).alias("s"), (~F.col("success")).alias("failed"))


@query(_auc(""))
def roc_auc(spark, d):
    return metrics.ranking_report(_failures(spark, d), "s", "failed")


@query(_auc("task"))
def roc_auc_by_task(spark, d):
    return metrics.ranking_report(_failures(spark, d), "s", "failed", ["task"])


@query(f"""WITH {PAIRS}, prior AS (SELECT task, avg((NOT success)::INT) AS s FROM pairs WHERE pair_id % 2 = 0 GROUP BY task),
e AS (SELECT s, count(*) AS c, sum((NOT success)::INT) AS pos FROM pairs JOIN prior USING (task) WHERE pair_id % 2 = 1 GROUP BY s),
u AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cum_pos FROM e)
SELECT sum(c)::BIGINT AS n, sum((c - pos) * (cum_pos - pos) + 0.5e0 * (c - pos) * pos) / (sum(pos) * (sum(c) - sum(pos))) AS roc_auc FROM u""")
def shortcut_check(spark, d):
    p = pairs(spark, d)
    prior = p.where("pair_id % 2 = 0").groupBy("task").agg(F.avg((~F.col("success")).cast("int")).alias("s"))
    rows = p.where("pair_id % 2 = 1").join(F.broadcast(prior), "task").select("s", (~F.col("success")).alias("failed"))
    return metrics.ranking_report(rows, "s", "failed").select("n", "roc_auc")


@query(f"""WITH {PAIRS}, s AS (SELECT count(*) AS n, avg((success = frontier_success)::INT) AS agreement, avg(success::INT) AS p, avg(frontier_success::INT) AS q FROM pairs)
SELECT n, agreement, (agreement - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))) AS kappa FROM s""")
def cohen_kappa(spark, d):
    return metrics.kappa(pairs(spark, d), "success", "frontier_success")


@query(f"""WITH {TURNS}, {GRADES}, r AS (
  SELECT teacher, student, rank() OVER (ORDER BY teacher) + (count(*) OVER (PARTITION BY teacher) - 1) / 2e0 AS a,
         rank() OVER (ORDER BY student) + (count(*) OVER (PARTITION BY student) - 1) / 2e0 AS b FROM grades)
SELECT count(*) AS n, corr(a, b) AS spearman, corr(teacher, student) AS pearson FROM r""")
def spearman(spark, d):
    return metrics.spearman(grades(spark, d), "teacher", "student")


@query(f"""WITH {TURNS}, {GRADES}, r AS (SELECT *, greatest(1, least(5, round_even(student, 0))) AS k FROM grades)
SELECT count(*) AS n, avg((k = teacher)::INT) AS exact, avg((abs(k - teacher) <= 1)::INT) AS within_one, avg(abs(student - teacher)) AS mae,
       avg(student - teacher) AS bias FROM r""")
def grade_agreement(spark, d):
    return metrics.grade_agreement(grades(spark, d), "teacher", "student")


@query(f"""WITH {TURNS}, {GRADES}, d AS (SELECT teacher - student AS d FROM grades),
r AS (SELECT d, abs(d) AS m, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS r FROM d WHERE d <> 0),
t AS (SELECT sum(c) AS k, sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT m, count(*) AS c FROM r GROUP BY m)),
w AS (SELECT coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus FROM r)
SELECT (SELECT count(*) FROM d) AS n, (SELECT avg(d) FROM d) AS mean_diff, (SELECT avg((d > 0)::INT) FROM d) AS higher, (SELECT avg((d < 0)::INT) FROM d) AS lower,
       (SELECT avg((d = 0)::INT) FROM d) AS tied, w_plus, (w_plus - k * (k + 1) / 4e0) / sqrt(k * (k + 1) * (2 * k + 1) / 24e0 - ties / 48e0) AS z FROM t, w""")
def paired_win_rate(spark, d):
    return metrics.paired_comparison(grades(spark, d), "teacher", "student")


def signed_rank_test(spark, d):
    """paired_win_rate with the p-value of its signed ranks."""
    return metrics.signed_rank(grades(spark, d), "teacher", "student")


query()(signed_rank_test)


@query("""WITH s AS (SELECT l_suppkey AS k, date_diff('day', TIMESTAMP '1990-01-01', l_shipdate)::BIGINT AS start, l_returnflag AS flag, CASE WHEN l_linenumber = 7 THEN 900 ELSE l_quantity::BIGINT END AS days FROM lineitem)
SELECT a.k AS l_suppkey, count(*) AS pairs, sum(least(a.start + a.days, b.start + b.days) - greatest(a.start, b.start))::BIGINT AS days FROM s a JOIN s b
ON a.k = b.k AND a.start < b.start + b.days AND b.start < a.start + a.days WHERE a.flag = 'R' AND b.flag = 'A' GROUP BY a.k""")
def overlapping_shipments(spark, d):
    """Per supplier the pairs of returned and accepted lines that are under way at once, a line for as many days as it has pieces."""
    start = F.date_diff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    days = F.when(F.col("l_linenumber") == 7, 900).otherwise(F.col("l_quantity").cast("long"))
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", start.alias("s"), (start + days).alias("e"))
    side = lambda flag, x: lines.where(F.col("l_returnflag") == flag).select("l_suppkey", F.col("s").alias(f"{x}s"), F.col("e").alias(f"{x}e"))
    met = overlap.overlapping(side("R", "a"), side("A", "b"), ["l_suppkey"], ("as", "ae"), ("bs", "be"), 16)
    return met.groupBy("l_suppkey").agg(F.count("*").alias("pairs"), F.sum(F.least("ae", "be") - F.greatest("as", "bs")).alias("days"))


@query(f"""WITH {TURNS}, {GRADES} SELECT count(*) AS n, avg((student < 2)::INT) FILTER (WHERE teacher < 3) AS flag_rate_wrong,
avg((student < 2)::INT) FILTER (WHERE NOT teacher < 3) AS flag_rate_right FROM grades""")
def usefulness(spark, d):
    g = grades(spark, d).select((F.col("student") < 2).alias("f"), (F.col("teacher") < 3).alias("w"))
    return metrics.usefulness(g, "f", "w")


@query(f"""WITH {TURNS}, t AS (SELECT conv_id, turn, regexp_extract_all(lower(reply), '[a-z0-9'']+') AS p, regexp_extract_all(lower(request), '[a-z0-9'']+') AS r FROM turns)
SELECT conv_id, turn, coalesce(2e0 * list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(r, lambda y: y = x)))))
  / nullif(len(p) + len(r), 0), 0) AS f1 FROM t""")
def token_f1_turns(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.token_f1(F.col("reply"), F.col("request")).alias("f1"))


@query(f"""WITH {TURNS}, g AS (SELECT substr(sha256(lower(regexp_replace(trim(request), '\\s+', ' ', 'g'))), 1, 16) AS h FROM turns) SELECT h, count(*) AS n FROM g GROUP BY h""")
def request_groups(spark, d):
    return turns(spark, d).groupBy(T.group_hash(F.col("request")).alias("h")).agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS}, {PREDICTIONS}, s AS (SELECT gold, prediction, count(*) AS n FROM predictions WHERE gold <> prediction GROUP BY ALL)
SELECT * FROM s ORDER BY n DESC, gold, prediction LIMIT 12""")
def confusion_pairs(spark, d):
    wrong = predictions(spark, d).where("gold <> prediction").groupBy("gold", "prediction").agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "gold", "prediction").limit(12)


DRAWN = "('0x' || substr(md5(replicate || '|' || d || '|0'), 1, 8))::BIGINT"


@query(f"""WITH {TURNS}, t AS (SELECT *, row_number() OVER (ORDER BY conv_id * 100 + turn) - 1 AS i, count(*) OVER () AS n FROM turns),
r AS (SELECT replicate, sum(length(request) - length(reply))::DOUBLE / sum(length(request) + length(reply)) AS d FROM (
  SELECT replicate, {DRAWN} % n AS i FROM (SELECT unnest(range(100)) AS replicate), (SELECT unnest(range((SELECT count(*) FROM t))) AS d, (SELECT count(*) FROM t) AS n)) x
  JOIN t USING (i) GROUP BY replicate)
SELECT count(d) AS replicates, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM r""")
def bootstrap_ci(spark, d):
    t = turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.length("request").alias("a"), F.length("reply").alias("b"))
    return bootstrap.ratio_difference(t.withColumn("base", F.col("a") + F.col("b")), "k", "a", "b", "base", replicates=100)


RESAMPLED = f"""t AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM rows),
x AS (SELECT replicate, t.* FROM (SELECT replicate, {DRAWN} % n AS i FROM (SELECT unnest(range(REPLICATES)) AS replicate), (SELECT unnest(range((SELECT count(*) FROM rows))) AS d, (SELECT count(*) FROM rows) AS n)) JOIN t USING (i))"""


@query(f"""WITH {TURNS}, {GRADES}, rows AS (SELECT conv_id * 100 + turn AS k, student - teacher AS v FROM grades), {RESAMPLED.replace("REPLICATES", "60")},
r AS (SELECT replicate, avg(v) AS d FROM x GROUP BY replicate) SELECT count(d) AS replicates, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM r""")
def mean_difference_ci(spark, d):
    g = grades(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), (F.col("student") - F.col("teacher")).alias("v"))
    return bootstrap.mean_difference(g, "k", "v", replicates=60)


@query(f"""WITH {TURNS}, {GRADES}, rows AS (SELECT conv_id * 100 + turn AS k, teacher AS y, student AS a, (conv_id % 7)::DOUBLE AS b FROM grades), {RESAMPLED.replace("REPLICATES", "20")},
q AS (SELECT replicate, rank() OVER (PARTITION BY replicate ORDER BY y) + (count(*) OVER (PARTITION BY replicate, y) - 1) / 2e0 AS y,
  rank() OVER (PARTITION BY replicate ORDER BY a) + (count(*) OVER (PARTITION BY replicate, a) - 1) / 2e0 AS a,
  rank() OVER (PARTITION BY replicate ORDER BY b) + (count(*) OVER (PARTITION BY replicate, b) - 1) / 2e0 AS b FROM x),
r AS (SELECT replicate, corr(y, a) - corr(y, b) AS d FROM q GROUP BY replicate) SELECT count(d) AS replicates, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM r""")
def rank_correlation_ci(spark, d):
    g = grades(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.col("teacher").alias("y"), F.col("student").alias("a"), (F.col("conv_id") % 7).cast("double").alias("b"))
    return bootstrap.rank_correlation_difference(g, "k", "y", "a", "b", replicates=20)


def paired_bootstrap(spark, d):
    p = pairs(spark, d).withColumn("c", -F.col("mean_logprob")).withColumn("l", F.col("n_chars").cast("double"))
    return bootstrap.paired_quality(p, "pair_id", ("c", "l"), 0.2, replicates=50)


query()(paired_bootstrap)


def bootstrap_ci_by_weights(spark, d):
    """bootstrap_ci with 10,000 replicates."""
    t = turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.length("request").alias("a"), F.length("reply").alias("b"))
    return bootstrap.ratio_difference_by_weights(t.withColumn("base", F.col("a") + F.col("b")), "k", "a", "b", "base")


def mean_difference_ci_by_weights(spark, d):
    """mean_difference_ci with 10,000 replicates."""
    g = grades(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), (F.col("student") - F.col("teacher")).alias("v"))
    return bootstrap.mean_difference_by_weights(g, "k", "v")


def paired_bootstrap_by_weights(spark, d):
    """paired_bootstrap with 2,000 replicates."""
    p = pairs(spark, d).withColumn("c", -F.col("mean_logprob")).withColumn("l", F.col("n_chars").cast("double"))
    return bootstrap.paired_quality_by_weights(p, "pair_id", ("c", "l"), 0.2)


for f in (bootstrap_ci_by_weights, mean_difference_ci_by_weights, paired_bootstrap_by_weights):
    query()(f)


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (
  SELECT q.vec_id AS id, t.vec_id AS t, list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS s FROM q JOIN embeddings t ON t.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, t) AS r FROM s)
SELECT id, avg(s) AS similarity FROM r WHERE r <= 5 GROUP BY id""")
def embedding_similarity(spark, d):
    """The mean cosine of the five nearest of all other vectors, for every 50th id."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return features.nearest_vectors(e.where("id % 50 = 0"), e)


def embedding_similarity_all(spark, d):
    """embedding_similarity without its ids: every vector against all others."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return features.nearest_vectors(e, e)


query()(embedding_similarity_all)


@query("""WITH g AS (SELECT item_id AS id, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM benchmark), g2 AS (SELECT * FROM g WHERE term <> ''),
q AS (SELECT conv_id * 100 + turn AS id, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM conversations), q2 AS (SELECT * FROM q WHERE term <> ''),
idf AS (SELECT term, ln((1e0 + (SELECT count(*) FROM benchmark)) / (1e0 + count(DISTINCT id))) + 1 AS idf FROM g2 GROUP BY term HAVING count(DISTINCT id) >= 2),
tw AS (SELECT id, term, (1 + ln(count(*))) * any_value(idf) AS r FROM g2 JOIN idf USING (term) GROUP BY id, term),
qw AS (SELECT id, term, (1 + ln(count(*))) * any_value(idf) AS r FROM q2 JOIN idf USING (term) GROUP BY id, term),
tn AS (SELECT *, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS w FROM tw), qn AS (SELECT *, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS w FROM qw),
s AS (SELECT qn.id, tn.id AS t, sum(qn.w * tn.w) AS s FROM qn JOIN tn USING (term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, t) AS r FROM s)
SELECT id, sum(s) / 5 AS similarity FROM k WHERE r <= 5 GROUP BY id""")
def knn_similarity(spark, d):
    text = F.lower("text").alias("text")
    train = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text)
    return features.nearest_texts(table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), text), T.words, train)


def char_gram_similarity(spark, d):
    """Rows (conv_id, turn, similarity) of all turns; 0 without a known gram."""
    turn = F.struct("conv_id", "turn").alias("id")
    asked = table(spark, d, "conversations").select(turn, "text")
    near = features.nearest_texts(asked, features.char_grams, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    every = asked.select("id").distinct().join(near, "id", "left")
    return every.select("id.conv_id", "id.turn", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


query()(char_gram_similarity)


@query("""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z'']+')) AS w FROM benchmark),
s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z'']+')) AS w FROM conversations)
SELECT count(*) AS words, count(*) FILTER (WHERE w NOT IN (SELECT w FROM k)) AS novel, count(*) FILTER (WHERE w NOT IN (SELECT w FROM k))::DOUBLE / count(*) AS rate FROM s""")
def vocab_novelty(spark, d):
    return features.vocabulary_novelty(table(spark, d, "benchmark"), table(spark, d, "conversations"))


def topic_clusters(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return features.clusters(c, "text", ["conv_id", "turn"], k=5).groupBy("cluster").agg(F.count("*").alias("n"))


def failure_model(spark, d):
    p = pairs(spark, d).withColumn("label", (~F.col("success")).cast("double")).withColumn("chars", F.log1p("n_chars"))
    out = features.logistic(p.where("pair_id % 2 = 0"), p.where("pair_id % 2 = 1"), ["mean_logprob", "chars"], "label", balanced=True)
    return out.select("pair_id", "probability")


def text_probe(spark, d):
    """How well the words of a turn, and its length alone, tell users from assistants."""
    c = spread(table(spark, d, "conversations").where("role in ('user', 'assistant') and text is not null"))
    rows = c.select(F.struct("conv_id", "turn").cast("string").alias("id"), "text", (F.col("role") == "user").alias("label"))
    length = F.array(F.concat(F.lit("chars"), F.floor(F.log2(F.length("text") + 1)).cast("string")))
    return features.probe(rows, {"words": features.word_runs(F.col("text")), "length": length}, "label", folds=3)


def router_grid(spark, d):
    """The log loss of each penalty of a router over tasks and their signals, by stratified folds."""
    return judging.penalties_table(spark, _searched(spark, d)[0])


def router_cascade(spark, d):
    """The curve on held-out pairs under the router with the best penalty."""
    search, test = _searched(spark, d)
    return judging.curve_of(test, search.fits[search.best].probability(), [0.0, 0.1, 0.2, 0.5, 1.0])[0]


def _searched(spark, d):
    p = pairs(spark, d).withColumn("rescue", (F.col("frontier_success") & ~F.col("success")).cast("int")).withColumn("chars", F.log1p("n_chars"))
    tasks = [r["task"] for r in p.select("task").distinct().orderBy("task").collect()]  # a handful
    design, columns = judging.by_task(p, tasks, ["mean_logprob", "chars"])
    train = models.folded(design.where("pair_id % 2 = 0"), "pair_id", ["task", "rescue"], 5)
    return models.grid(train, columns, "rescue", [0.01, 0.1, 1.0, 10.0]), design.where("pair_id % 2 = 1")


query()(router_grid)
query()(router_cascade)
query()(text_probe)
query()(topic_clusters)
query()(failure_model)


@query("""SELECT vec_id, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS scale FROM embeddings""")
def int8_scales(spark, d):
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", (F.array_max(F.transform(v, F.abs)) / 127).alias("scale"))


@query("""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS scale FROM embeddings)
SELECT vec_id, list_max(list_transform(v, lambda x: abs(x - greatest(-127, least(127, round_even(x / scale, 0))) * scale))) AS error FROM s""")
def int8_error(spark, d):
    v = F.col("embedding").cast("array<double>")
    e = F.array_max(F.zip_with(v, T.int8_round_trip(F.col("embedding")), lambda a, b: F.abs(a - b)))
    return table(spark, d, "embeddings").select("vec_id", e.alias("error"))
