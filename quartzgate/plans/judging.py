"""Queries over the operators that bring graders, gates and routed runs together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import judging, quantiles
from ..sources.tables import table
from .base import GRADES, PAIRS, PREDICTIONS, REQUESTS, TURNS, grades, pairs, predictions, turns
from .registry import query
from .routing import POLICY_ROWS

P = f"WITH {PAIRS}"
G = f"WITH {TURNS}, {GRADES}"


@query(f"""{P}, k AS (SELECT * FROM pairs WHERE n_chars % 2 = 0 AND n_chars % 3 = 0), m AS (
SELECT 'label' AS metric, success AS a, frontier_success AS b FROM k UNION ALL SELECT 'length', n_chars > 200, n_chars > 100 FROM k)
SELECT metric, count(*) AS n, avg(a::INT) AS local, avg(b::INT) AS frontier, count(*) FILTER (WHERE NOT a AND b) AS rescued, count(*) FILTER (WHERE a AND NOT b) AS broken FROM m GROUP BY metric""")
def escalation_under_judge(spark, d):
    p = pairs(spark, d)
    judged = p.select("pair_id", (F.col("n_chars") > 200).alias("la"), (F.col("n_chars") > 100).alias("lb")).where("pair_id is not null")
    keys = [p.where(f"n_chars % {m} = 0").select("pair_id") for m in (2, 3)]
    both = judging.together([p.select("pair_id", "success", "frontier_success"), judged, *keys], "pair_id")
    return judging.escalation_by_metric(both, {"label": ("success", "frontier_success"), "length": ("la", "lb")})


@query(f"""{G}, r AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, teacher AS g, turn % 3 = 0 AS cap FROM grades)
SELECT arm, count(g) AS n, avg(g) AS mean, avg((g >= 4)::INT) AS good, count(*) FILTER (WHERE cap) AS capped, avg(g) FILTER (WHERE cap) AS mean_capped,
avg(g) FILTER (WHERE NOT cap) AS mean_free FROM r GROUP BY arm""")
def arm_summary(spark, d):
    arm = F.when(F.col("conv_id") % 2 == 0, "a").otherwise("b")
    return judging.arm_summary(grades(spark, d).select(arm.alias("arm"), "teacher", (F.col("turn") % 3 == 0).alias("cap")), "arm", "teacher", "cap")


@query(f"""{G}, r AS (SELECT teacher, CASE WHEN turn % 5 <> 0 THEN student END AS student FROM grades)
SELECT count(student) AS graded, 500 - count(student) AS missing, count(student) = 500 AS complete, avg(student - teacher) AS bias FROM r""")
def graded_report(spark, d):
    g = grades(spark, d).select("teacher", F.when(F.col("turn") % 5 != 0, F.col("student")).alias("student"))
    return judging.graded_report(g, 500)


@query(f"""{G}, r AS (SELECT conv_id % 9 AS run FROM turns GROUP BY 1), m AS (SELECT conv_id % 9 AS run, avg(teacher) AS m, count(*) AS n FROM grades WHERE conv_id % 9 < 6 GROUP BY 1)
SELECT run, m AS judge_mean, coalesce(n, 0) AS judge_n FROM r LEFT JOIN m USING (run)""")
def filled_judge_means(spark, d):
    run = (F.col("conv_id") % 9).alias("run")
    g = grades(spark, d).select(run, F.col("teacher").alias("grade")).where("run < 6")
    return judging.filled_means(turns(spark, d).select(run).distinct(), g, ["run"])


@query(f"WITH {TURNS} SELECT max(ceil(length(request) / 4e0)) AS longest, 120 + max(ceil(length(request) / 4e0)) + 64 AS need, 120 + max(ceil(length(request) / 4e0)) + 64 <= 4096 AS fits FROM turns")
def prompt_budget(spark, d):
    t = turns(spark, d).select(F.ceil(F.length("request") / 4).cast("double").alias("tokens"))
    return judging.prompt_budget(F.lit(120), t, "tokens", 64, 4096)


@query(f"WITH {TURNS} SELECT turn, count(*) AS n, count(*) FILTER (WHERE length(reply) > 120) AS cut, avg((length(reply) > 120)::INT) AS share FROM turns GROUP BY turn")
def truncated_answers(spark, d):
    t = turns(spark, d).select("turn", F.when(F.length("reply") > 120, "length").otherwise("stop").alias("reason"))
    return judging.truncations(t, ["turn"], "reason")


@query(f"WITH {REQUESTS} SELECT count(*) AS requests, count(*) FILTER (WHERE route = 'fallback') AS fallbacks, avg((route = 'fallback')::INT) AS rate FROM requests")
def fallback_summary(spark, d):
    route = F.when(F.col("event_type") == "error", "fallback").otherwise("local")
    return judging.fallback_summary(table(spark, d, "events").select(route.alias("route")), "route")


@query(f"""{P}, a AS (SELECT task, stddev_samp(n_chars) AS spread FROM pairs WHERE task < 'es' GROUP BY task), b AS (SELECT task, 1e0 * max(n_chars) AS spread FROM pairs WHERE task < 'fr' GROUP BY task),
t AS (SELECT DISTINCT task FROM pairs) SELECT task, coalesce(a.spread, b.spread) AS spread, CASE WHEN a.spread IS NOT NULL THEN 'first' WHEN b.spread IS NOT NULL THEN 'second' END AS origin
FROM t LEFT JOIN a USING (task) LEFT JOIN b USING (task)""")
def preferred_spreads(spark, d):
    p = pairs(spark, d)
    a = p.where("task < 'es'").groupBy("task").agg(F.stddev_samp("n_chars").alias("spread"))
    b = p.where("task < 'fr'").groupBy("task").agg(F.max(F.col("n_chars").cast("double")).alias("spread"))
    return judging.preferred(p, a, b, ["task"], "spread")


GATES = "(VALUES ('en', 1, 0.01e0), ('en', 3, 0.03e0), ('fr', 2, 0.02e0)) g(task, version, threshold)"


@query(f"""{P}, l AS (SELECT task, arg_max(threshold, version) AS threshold, max(version)::INT AS version FROM {GATES} GROUP BY task)
SELECT task, threshold, version, CASE WHEN threshold IS NULL THEN 'report' ELSE 'block' END AS mode FROM (SELECT DISTINCT task FROM pairs) LEFT JOIN l USING (task)""")
def current_gate(spark, d):
    gates = spark.createDataFrame([("en", 1, 0.01), ("en", 3, 0.03), ("fr", 2, 0.02)], "task string, version int, threshold double")
    return judging.current_gate(pairs(spark, d), gates)


SYSTEMS = """s AS (SELECT 'model' AS system, split, prediction = gold AS hit FROM predictions UNION ALL SELECT 'majority', split, gold = 'good' FROM predictions
UNION ALL SELECT 'length', split, (n_chars % 2 = 0) = (gold = 'good') FROM predictions JOIN (SELECT pair_id, n_chars FROM pairs) USING (pair_id))"""


@query(f"""WITH {PAIRS}, {PREDICTIONS}, {SYSTEMS}, a AS (SELECT system, avg(hit::INT) FILTER (WHERE split = 'random') AS random, avg(hit::INT) FILTER (WHERE split = 'hard') AS hard FROM s GROUP BY system)
SELECT system, random, hard, random - hard AS drop, random - hard > 0.01 AS over_threshold, random - hard > 3 * 0.02 AS over_spread FROM a""")
def hard_sensitivity(spark, d):
    p = predictions(spark, d).join(pairs(spark, d).select("pair_id", "n_chars"), "pair_id")
    right = {"model": F.col("prediction") == F.col("gold"), "majority": F.col("gold") == "good", "length": (F.col("n_chars") % 2 == 0) == (F.col("gold") == "good")}
    systems = F.explode(F.array(*[F.struct(F.lit(k).alias("system"), v.alias("hit")) for k, v in right.items()]))
    rows = p.select("split", systems.alias("s")).select("split", "s.*")
    limits = spark.createDataFrame([(k, 0.01, 0.02) for k in right], "system string, threshold double, spread double")
    return judging.hard_sensitivity(rows, "system", "split", "hit", limits)


@query(f"""{P}, r AS (SELECT task, 'success' AS metric, avg(success::INT) AS value FROM pairs GROUP BY task), o AS (SELECT task, 'success' AS metric, avg(frontier_success::INT) AS value FROM pairs GROUP BY task)
SELECT * FROM r WHERE task <> 'fr' UNION ALL SELECT * FROM o WHERE task = 'fr'""")
def candidate_record(spark, d):
    record = lambda c: pairs(spark, d).groupBy("task").agg(F.avg(F.col(c).cast("int")).alias("value")).select("task", F.lit("success").alias("metric"), "value")
    return judging.candidate_record(record("success"), record("frontier_success"), "fr")


@query(f"""{P}, r AS (SELECT source, n_chars % 5 = 0 AS f, mean_logprob < -0.7 AS u, NOT success AS w FROM pairs)
SELECT source, count(*) AS n, avg(f::INT) FILTER (WHERE w) AS flag_wrong, avg(f::INT) FILTER (WHERE NOT w) AS flag_right, avg(u::INT) FILTER (WHERE w) AS unsure_wrong,
avg(u::INT) FILTER (WHERE NOT w) AS unsure_right, avg((f OR u)::INT) FILTER (WHERE w) AS either_wrong, avg((f OR u)::INT) FILTER (WHERE NOT w) AS either_right FROM r GROUP BY source""")
def shift_block(spark, d):
    return judging.shift_block(pairs(spark, d), F.col("n_chars") % 5 == 0, F.col("mean_logprob") < -0.7, ~F.col("success"), "source")


@query(f"{P} SELECT pair_id, (NOT success AND frontier_success)::INT AS positive FROM pairs")
def router_target(spark, d):
    return judging.target_of(pairs(spark, d), "rescue").select("pair_id", "positive")


@query(f"""{P}, s AS (SELECT *, CASE WHEN n_chars % 3 <> 0 THEN mean_logprob END AS score, CASE WHEN n_chars > 500 THEN 'shift' ELSE 'in' END AS side FROM pairs)
SELECT population, count(*) AS n, avg(success::INT) AS quality FROM (SELECT *, unnest(['all', side]) AS population FROM s WHERE score IS NOT NULL) GROUP BY population""")
def populations(spark, d):
    s = pairs(spark, d).withColumn("score", F.when(F.col("n_chars") % 3 != 0, F.col("mean_logprob"))).withColumn("side", F.when(F.col("n_chars") > 500, "shift").otherwise("in"))
    return judging.by_population(s, "side", F.col("score")).groupBy("population").agg(F.count("*").alias("n"), F.avg(F.col("success").cast("int")).alias("quality"))


def _document(population: str, view: str, where: str) -> str:
    rows = POLICY_ROWS.replace("FROM pairs", f"FROM (SELECT * FROM pairs WHERE {where})").replace("0.05e0, 0.1e0, 0.2e0, 0.3e0, 0.5e0, 0.75e0, ", "0.2e0, ")
    return f"""SELECT * FROM (WITH {rows} SELECT '{population}' AS population, '{view}' AS "view", policy, budget, count(*) AS n,
    count(*) FILTER (WHERE rnk <= round_even(budget * total, 0)) AS escalated, count(*) FILTER (WHERE rnk <= round_even(budget * total, 0))::DOUBLE / count(*) AS escalation_rate,
    sum(CASE WHEN rnk <= round_even(budget * total, 0) THEN frontier_success ELSE success END::INT)::DOUBLE / count(*) AS quality,
    min(CASE WHEN rnk <= round_even(budget * total, 0) THEN score END) AS threshold FROM ranked CROSS JOIN budgets GROUP BY policy, budget)"""


_SIDES = {"all": "TRUE", "in": "n_chars <= 500", "shift": "n_chars > 500"}


@query(f"{P} " + " UNION ALL ".join(_document(p, v, f"{w} AND {r}") for p, w in _SIDES.items() for v, r in (("all", "TRUE"), ("real", "n_chars % 4 <> 0"))))
def report_document(spark, d):
    p = pairs(spark, d).withColumn("side", F.when(F.col("n_chars") > 500, "shift").otherwise("in"))
    return judging.report_document(p, "side", F.col("n_chars") % 4 != 0, [0.0, 0.2, 1.0])


@query(f"""{P} SELECT pair_id, task, success AS recorded_success, frontier_success AS recorded_frontier_success, mean_logprob AS recorded_mean_logprob,
mean_logprob < -0.5 AS recorded_escalated, 'local' AS route, success AS served_success FROM pairs""")
def direct_requests(spark, d):
    return judging.sent_directly(pairs(spark, d), -0.5)


@query(f"{P} SELECT pair_id, task, CASE WHEN task IN ('de', 'fr') THEN 'classical' ELSE 'adapter' END AS backend FROM pairs WHERE task IN ('en', 'de', 'fr')")
def dispatched_pairs(spark, d):
    return judging.dispatched(pairs(spark, d), ["de", "fr"], ["en", "de", "fr"]).select("pair_id", "task", "backend")


@query("""SELECT n_name AS component, CASE WHEN n_regionkey = 1 THEN md5(n_name || 'x') ELSE md5(n_name) END AS digest, n_regionkey = 1 AS swapped FROM nation""")
def swapped_pins(spark, d):
    n = table(spark, d, "nation")
    pins = n.select(F.col("n_name").alias("component"), F.md5("n_name").alias("digest"))
    swaps = n.where("n_regionkey = 1").select(F.col("n_name").alias("component"), F.md5(F.concat("n_name", F.lit("x"))).alias("digest"))
    return judging.pins_with(pins, swaps)


@query(f"""{P}, i AS (SELECT task AS variant, avg(success::INT) - 0.05 AS low, avg(success::INT) + 0.05 AS high FROM pairs GROUP BY task)
SELECT variant, low, high, coalesce(low > 0.8, FALSE) AS taken FROM i""")
def decision_rule(spark, d):
    m = F.avg(F.col("success").cast("int"))
    i = pairs(spark, d).groupBy(F.col("task").alias("variant")).agg((m - 0.05).alias("low"), (m + 0.05).alias("high"))
    return judging.decision(i, 0.8)


@query(f"""WITH {REQUESTS}, r AS (SELECT route, sum(tokens)::BIGINT AS tokens FROM requests GROUP BY route)
SELECT route, tokens, tokens * CASE route WHEN 'escalated' THEN 2.5e0 WHEN 'local' THEN 0.1e0 END / 1e6 AS cost FROM r""")
def priced_routes(spark, d):
    e, kind = table(spark, d, "events"), F.col("event_type")
    route = F.when(kind == "error", "fallback").when(kind == "purchase", "escalated").when(kind == "signup", "out_of_domain").otherwise("local")
    rows = e.select(route.alias("route"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return judging.priced(rows, spark.createDataFrame([("escalated", 2.5), ("local", 0.1)], "route string, per_million double"))


@query(f"{P} SELECT pair_id, exp(mean_logprob) AS p FROM pairs")
def token_probabilities(spark, d):
    return pairs(spark, d).select("pair_id", T.token_probability(F.col("mean_logprob")).alias("p"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'NONE' WHEN event_type IN ('click', 'view') THEN event_type END AS answer FROM events""")
def parsed_answers(spark, d):
    raw = F.when(F.col("event_type") == "error", " None.\nmore").otherwise(F.concat(F.upper("event_type"), F.lit(".\nsecond line")))
    return table(spark, d, "events").select("event_id", T.parsed_answer(raw, ["click", "view"]).alias("answer"))


@query("""WITH t AS (SELECT 'benchmark' AS task, text, row_number() OVER (ORDER BY item_id) - 1 AS p FROM benchmark
UNION ALL SELECT 'pages', url, row_number() OVER (ORDER BY page_id) - 1 FROM pages) SELECT 'golden-' || task || '-' || CASE WHEN p < 10000 THEN lpad(p::VARCHAR, 4, '0') ELSE p::VARCHAR END AS item_id, task, text FROM t""")
def golden_plan(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.col("url").alias("text"))
    return judging.golden_plan({"benchmark": table(spark, d, "benchmark"), "pages": pages}, "text", "item_id")


@query(f"WITH {TURNS} SELECT turn, count(*) AS n, avg((length(reply) / 4e0 >= 40)::INT) AS at_cap FROM turns GROUP BY turn")
def share_at_cap(spark, d):
    return judging.at_cap(turns(spark, d).withColumn("tokens", F.length("reply") / 4), "turn", "tokens", 40)


@query(f"""{G}, r AS (SELECT conv_id, turn, 'asked' AS generator, length(request) AS chars FROM turns UNION ALL SELECT conv_id, turn, 'answered', length(reply) FROM turns)
SELECT r.conv_id, r.turn, generator, chars, CASE generator WHEN 'asked' THEN teacher ELSE student END AS grade FROM r JOIN grades USING (conv_id, turn)
WHERE generator = 'asked' OR turn % 4 <> 1""")
def graded_from_two(spark, d):
    g = grades(spark, d)
    both = g.select("conv_id", "turn", F.lit("asked").alias("generator"), F.col("teacher").alias("grade")).unionByName(
        g.select("conv_id", "turn", F.lit("answered").alias("generator"), F.when(F.col("turn") % 4 != 1, F.col("student")).alias("grade"))
    )
    out = judging.graded_from_two(turns(spark, d), both, ["conv_id", "turn"], {"asked": "request", "answered": "reply"})
    return out.select("conv_id", "turn", "generator", F.length("answer").alias("chars"), "grade")


@query(f"{P} SELECT task, quantile_cont(n_chars::DOUBLE, 0.9) AS threshold FROM pairs GROUP BY task")
def pinned_thresholds(spark, d):
    """Pins fitted by selection, confirmed by a fit from a full order of each task."""
    rows = pairs(spark, d)
    fitted = lambda limit: quantiles.exact(rows, "n_chars", [0.9], ["task"], limit=limit).select("task", F.col("q")[0].alias("threshold"))
    return judging.pinned(fitted(0), fitted(quantiles.LIMIT), "task", "threshold")


@query(f"""{P}, a AS (SELECT task, quantile_cont(n_chars::DOUBLE, 0.9) AS pinned FROM pairs WHERE pair_id % 2 = 0 GROUP BY task),
b AS (SELECT task, quantile_cont(n_chars::DOUBLE, 0.9) AS again FROM pairs GROUP BY task) SELECT task, pinned, again, pinned IS DISTINCT FROM again AS moved FROM a FULL JOIN b USING (task)""")
def threshold_drift(spark, d):
    """Thresholds pinned on half of the pairs beside those of all: `pinned` refuses the ones that moved."""
    fit = lambda rows, name: quantiles.exact(rows, "n_chars", [0.9], ["task"]).select("task", F.col("q")[0].alias(name))
    p = pairs(spark, d)
    both = fit(p.where("pair_id % 2 = 0"), "pinned").join(fit(p, "again"), "task", "full")
    return both.withColumn("moved", ~F.col("pinned").eqNullSafe(F.col("again")))


KIND = "CASE n_chars % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'grade' ELSE 'spans' END"


@query(f"""{P}, {PREDICTIONS}, r AS (SELECT pair_id, {KIND} AS kind, gold, prediction, n_chars % 5 + 1 AS grade, n_chars % 4 AS partly FROM predictions JOIN pairs USING (pair_id))
SELECT kind, count(*) AS n, count(*) FILTER (WHERE CASE kind WHEN 'label' THEN prediction <> gold OR prediction NOT IN ('good', 'bad') WHEN 'grade' THEN grade <= 3 ELSE partly > 0 END) AS errors
FROM r GROUP BY kind""")
def served_errors(spark, d):
    chars = pairs(spark, d).select("pair_id", F.expr(KIND).alias("kind"), (F.col("n_chars") % 5 + 1).alias("grade"), (F.col("n_chars") % 4).alias("partly"))
    rows = judging.served_errors(predictions(spark, d).join(chars, "pair_id"), "kind", ["good", "bad"])
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("served_error").alias("errors"))


@query(f"""{P}, {PREDICTIONS}, r AS (SELECT task, CASE WHEN n_chars % 6 <> 0 THEN gold END AS gold, prediction, mean_logprob < -0.5 AS e FROM predictions JOIN pairs USING (pair_id, task)),
s AS (SELECT *, CASE WHEN gold IS NOT NULL THEN prediction = gold END AS ok FROM r)
SELECT task, count(*) AS n, count(*) FILTER (WHERE gold IS NULL) AS no_fit, count(*) FILTER (WHERE prediction NOT IN ('good', 'bad')) AS invented, avg(ok::INT) AS accuracy,
  avg(CASE WHEN ok THEN e::INT END) AS escalated_right, avg(CASE WHEN NOT ok THEN e::INT END) AS escalated_wrong FROM s GROUP BY task""")
def outside_block(spark, d):
    p = pairs(spark, d).select("pair_id", "n_chars", "mean_logprob")
    rows = predictions(spark, d).join(p, "pair_id").withColumn("gold", F.when(F.col("n_chars") % 6 != 0, F.col("gold")))
    return judging.outside_block(rows, "task", ["good", "bad"], F.col("mean_logprob") < -0.5)


def router_evaluation(spark, d):
    """The curve of a router fitted on the pairs with an even id and asked about the odd ones."""
    p = pairs(spark, d).withColumn("chars", F.log1p("n_chars"))
    return judging.evaluated(p.where("pair_id % 2 = 0"), p.where("pair_id % 2 = 1"), ["mean_logprob", "chars"], [0.0, 0.1, 0.2, 0.5, 1.0])[0]


query()(router_evaluation)
