"""What graders, gates and routed runs say together: composed comparisons, fills, budgets, candidates, decision rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features, metrics, models, ranking, routing

GOOD, WRONG = 4, 3


def together(frames: list[DataFrame], key: str) -> DataFrame:
    """The rows of all frames whose key is in every one of them."""
    return reduce(lambda a, b: a.join(b, key), frames)


def _rate(c: Column) -> Column:
    return F.avg(c.cast("int"))


def escalation_by_metric(rows: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """rows: local and frontier success by several metrics, of the same pairs. Per metric its success rates, what escalation
    rescues and what it breaks."""
    made = []
    for name, (local, frontier) in metrics.items():
        a, b = F.col(local), F.col(frontier)
        made.append(F.struct(F.lit(name).alias("metric"), a.alias("a"), b.alias("b")))
    each = rows.select(F.explode(F.array(*made)).alias("m")).select("m.*")
    return each.groupBy("metric").agg(
        F.count("*").alias("n"), _rate(F.col("a")).alias("local"), _rate(F.col("b")).alias("frontier"),
        F.count_if(~F.col("a") & F.col("b")).alias("rescued"), F.count_if(F.col("a") & ~F.col("b")).alias("broken"),
    )


def arm_summary(rows: DataFrame, arm: str, grade: str, at_cap: str) -> DataFrame:
    """Per arm: rows, mean grade, share of good ones, and the mean grades of answers that hit the token cap and of others."""
    g, cap = F.col(grade), F.col(at_cap)
    return rows.groupBy(arm).agg(
        F.count(g).alias("n"), F.avg(g).alias("mean"), _rate(g >= GOOD).alias("good"), F.count_if(cap).alias("capped"),
        F.avg(F.when(cap, g)).alias("mean_capped"), F.avg(F.when(~cap, g)).alias("mean_free"),
    )


def graded_report(rows: DataFrame, planned: int) -> DataFrame:
    """rows: (pair_id, teacher, student). One row: how much of the plan is graded by both, and whether all is."""
    both = F.col("teacher").isNotNull() & F.col("student").isNotNull()
    return rows.agg(
        F.count_if(both).alias("graded"), (F.lit(planned) - F.count_if(both)).alias("missing"), (F.count_if(both) == planned).alias("complete"),
        F.avg(F.when(both, F.col("student") - F.col("teacher"))).alias("bias"),
    )


def filled_means(runs: DataFrame, grades: DataFrame, keys: list[str]) -> DataFrame:
    """`runs` with judge_mean and judge_n of their grades (keys, grade); runs without a grade keep null and 0."""
    means = grades.groupBy(*keys).agg(F.avg("grade").alias("judge_mean"), F.count("grade").alias("judge_n"))
    return runs.join(means, keys, "left").withColumn("judge_n", F.coalesce("judge_n", F.lit(0)))


def prompt_budget(header: Column, queries: DataFrame, tokens: str, new: int, context: int) -> DataFrame:
    """One row: the longest prompt with `new` tokens to come, and whether it fits the context."""
    need = header + F.max(tokens) + new
    return queries.agg(F.max(tokens).alias("longest"), need.alias("need"), (need <= context).alias("fits"))


def truncations(rows: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Per group: answers, those cut off at the cap, and their share."""
    cut = F.col(reason) == "length"
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(cut).alias("cut"), F.try_divide(F.count_if(cut).cast("double"), F.count("*")).alias("share"))


def fallback_summary(rows: DataFrame, route: str) -> DataFrame:
    """One row: requests, fallbacks and their rate, null without requests."""
    n = F.count_if(F.col(route) == "fallback")
    return rows.agg(F.count("*").alias("requests"), n.alias("fallbacks"), F.try_divide(n.cast("double"), F.count("*")).alias("rate"))


def preferred(base: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`base` keys with the first source's value, else the second's, and which one it was; null where neither has one."""
    a, b = (f.select(*keys, F.col(value).alias(n)) for f, n in ((first, "_a"), (second, "_b")))
    both = base.select(*keys).distinct().join(a, keys, "left").join(b, keys, "left")
    origin = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second")
    return both.select(*keys, F.coalesce("_a", "_b").alias(value), origin.alias("origin"))


def current_gate(tasks: DataFrame, gates: DataFrame) -> DataFrame:
    """Per task the gate of the latest version that names it; without one a gate that only reports."""
    last = gates.groupBy("task").agg(F.max_by("threshold", "version").alias("threshold"), F.max("version").alias("version"))
    out = tasks.select("task").distinct().join(last, "task", "left")
    return out.withColumn("mode", F.when(F.col("threshold").isNull(), "report").otherwise("block"))


def hard_sensitivity(rows: DataFrame, system: str, split: str, right: str, thresholds: DataFrame) -> DataFrame:
    """rows: whether each system was right, on two splits. Per system: accuracy on both, the drop, and whether it exceeds the
    system's threshold and three times its spread. thresholds: (system, threshold, spread)."""
    r = F.col(right).cast("int")
    per = rows.groupBy(system).agg(F.avg(F.when(F.col(split) == "random", r)).alias("random"), F.avg(F.when(F.col(split) == "hard", r)).alias("hard"))
    drop = F.col("random") - F.col("hard")
    return per.join(thresholds, system).select(
        system, "random", "hard", drop.alias("drop"), (drop > F.col("threshold")).alias("over_threshold"), (drop > 3 * F.col("spread")).alias("over_spread")
    )


def candidate_record(record: DataFrame, override: DataFrame, task: str) -> DataFrame:
    """A run record (task, metric, value) in which one task's rows are another run's."""
    return record.where(F.col("task") != task).unionByName(override.where(F.col("task") == task).select(*record.columns))


def shift_block(rows: DataFrame, flag: Column, unsure: Column, wrong: Column, population: str) -> DataFrame:
    """Per population: how often a flag, low confidence or either is raised on wrong and on right answers."""
    each = rows.select(population, flag.alias("f"), unsure.alias("u"), (flag | unsure).alias("e"), wrong.alias("w"))
    rates = [_rate(F.when(F.col("w") == w, F.col(c))).alias(f"{name}_{side}") for c, name in (("f", "flag"), ("u", "unsure"), ("e", "either")) for w, side in ((True, "wrong"), (False, "right"))]
    return each.groupBy(population).agg(F.count("*").alias("n"), *rates)


def target_of(rows: DataFrame, target: str) -> DataFrame:
    """`rows` with `positive`, 1 where a router should escalate: failure of the local answer, or rescue by the frontier's."""
    if target not in ("failure", "rescue"):
        raise ValueError(f"no target {target}")
    fails = ~F.col("success")
    return rows.withColumn("positive", (fails if target == "failure" else fails & F.col("frontier_success")).cast("int"))


def by_population(rows: DataFrame, side: str, scored: Column) -> DataFrame:
    """Rows that have a score, once under `all` and once under their side, as `population`."""
    return rows.where(scored.isNotNull()).withColumn("population", F.explode(F.array(F.lit("all"), F.col(side))))


def report_document(rows: DataFrame, side: str, real: Column, budgets: list[float]) -> DataFrame:
    """Rows (population, view, policy, budget, quality, ...): the operating curve of each population, on all its rows and on
    those with real labels."""
    both = by_population(rows, side, F.col("mean_logprob"))
    out = []
    for name in [r[0] for r in both.select("population").distinct().orderBy("population").collect()]:  # a few populations
        for view, keep in (("all", F.lit(True)), ("real", real)):
            curve = routing.operating_curve(both.where((F.col("population") == name) & keep), budgets=budgets)
            out.append(curve.withColumns({"population": F.lit(name), "view": F.lit(view)}))
    return reduce(DataFrame.unionByName, out)


def request_set(rows: DataFrame, threshold: float) -> DataFrame:
    """Recorded pairs to be sent again: what was recorded under names of its own, and the decision at a threshold."""
    recorded = {c: f"recorded_{c}" for c in ("success", "frontier_success", "mean_logprob")}
    out = rows.select("pair_id", "task", *[F.col(a).alias(b) for a, b in recorded.items()])
    return out.withColumn("recorded_escalated", F.col("recorded_mean_logprob") < threshold)


def sent_directly(rows: DataFrame, threshold: float) -> DataFrame:
    """request_set as a sender serves it that records the decision but always answers locally."""
    return request_set(rows, threshold).withColumns({"route": F.lit("local"), "served_success": F.col("recorded_success")})


def dispatched(rows: DataFrame, classical: list[str], served: list[str]) -> DataFrame:
    """Rows of the served tasks with the backend that answers them."""
    return rows.where(F.col("task").isin(served)).withColumn("backend", F.when(F.col("task").isin(classical), "classical").otherwise("adapter"))


def pins_with(pins: DataFrame, swaps: DataFrame) -> DataFrame:
    """pins: (component, digest) with those of `swaps` in their place; an error where a swap names no pin."""
    unknown = swaps.join(pins, "component", "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} swaps name no pinned component")
    new = swaps.select("component", F.col("digest").alias("_new"))
    return pins.join(new, "component", "left").select("component", F.coalesce("_new", "digest").alias("digest"), F.col("_new").isNotNull().alias("swapped"))


def decision(intervals: DataFrame, least: float) -> DataFrame:
    """intervals: (variant, low, high). Whether a rule stated in advance takes a variant: its whole interval lies above `least`."""
    return intervals.withColumn("taken", F.coalesce(F.col("low") > least, F.lit(False)))


def priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """rows: (route, tokens); prices: (route, per_million). Per route: tokens and cost; a route without a price has none."""
    sums = rows.groupBy("route").agg(F.sum("tokens").alias("tokens"))
    return sums.join(prices, "route", "left").select("route", "tokens", (F.col("tokens") * F.col("per_million") / 1e6).alias("cost"))


def golden_plan(tables: dict[str, DataFrame], text: str, order: str) -> DataFrame:
    """Rows (item_id, task, text) of every task's golden table, named golden-<task>-<place from 0, four digits or more> in the
    order of a key, a number or a string; rows that share a key fall anyhow."""
    out = []
    for task, df in tables.items():
        rows = df.select(F.col(order).alias("_o"), F.col(text).alias("text"), (-F.col(order).try_cast("double")).alias("_k"))
        placed = ranking.ranked(rows, "_k", "_o", [], "_p")
        name = F.concat(F.lit(f"golden-{task}-"), F.format_string("%04d", F.col("_p").cast("long") - 1))
        out.append(placed.select(name.alias("item_id"), F.lit(task).alias("task"), "text"))
    return reduce(DataFrame.unionByName, out)


def at_cap(rows: DataFrame, group: str, tokens: str, cap: int) -> DataFrame:
    """Per group: rows and the share whose completion reached the token cap."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), _rate(F.col(tokens) >= cap).alias("at_cap"))


def graded_from_two(rows: DataFrame, grades: DataFrame, keys: list[str], sources: dict[str, str]) -> DataFrame:
    """One row for each answer of either generator (`sources`: name to column) that has a grade: keys, generator, answer, grade."""
    made = F.array(*[F.struct(F.lit(n).alias("generator"), F.col(c).alias("answer")) for n, c in sources.items()])
    each = rows.select(*keys, F.explode(made).alias("a")).select(*keys, "a.*")
    return each.join(grades.select(*keys, "generator", "grade"), [*keys, "generator"]).where("grade is not null")


def pinned(pins: DataFrame, recomputed: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """The pins, once each was computed again within the tolerance; an error otherwise."""
    both = pins.join(recomputed.select(key, F.col(value).alias("_again")), key, "full")
    wrong = both.where(F.coalesce(F.abs(F.col(value) - F.col("_again")) > tolerance, F.lit(True))).count()
    if wrong:
        raise ValueError(f"{wrong} pinned values are not reproduced")
    return pins


def served_errors(rows: DataFrame, kind: str, labels: list[str]) -> DataFrame:
    """`rows` with `served_error`, by the kind of their task: a label that is not the gold one or none of `labels`, a grade of
    WRONG or less, or a span that is not fully masked (partly); null where what decides is missing."""
    p = F.col("prediction")
    wrong = F.when(p.isNull(), F.lit(True)).otherwise((p != F.col("gold")) | ~p.isin(labels))
    by_kind = F.when(F.col(kind) == "label", wrong).when(F.col(kind) == "grade", F.col("grade") <= WRONG).when(F.col(kind) == "spans", F.col("partly") > 0)
    return rows.withColumn("served_error", by_kind)


def outside_block(rows: DataFrame, group: str, labels: list[str], escalated: Column) -> DataFrame:
    """rows: gold (null where no label fits) and prediction. Per group: rows, those no label fits, invented predictions, the
    accuracy where one fits, and how often right and wrong answers were escalated."""
    gold, p = F.col("gold"), F.col("prediction")
    right = F.when(gold.isNotNull(), F.coalesce(p == gold, F.lit(False)))
    return rows.select(group, gold, p, right.alias("_r"), escalated.cast("int").alias("_e")).groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(gold.isNull()).alias("no_fit"), F.count_if(~p.isin(labels)).alias("invented"),
        _rate(F.col("_r")).alias("accuracy"), F.avg(F.when(F.col("_r"), F.col("_e"))).alias("escalated_right"),
        F.avg(F.when(~F.col("_r"), F.col("_e"))).alias("escalated_wrong"),
    )


def by_task(rows: DataFrame, tasks: list[str], signals: list[str]) -> tuple[DataFrame, list[str]]:
    """(`rows` with columns for a model, their names): whether a row is of a task, and each signal within that task, else 0. A
    missing signal is an error."""
    missing = rows.where(F.greatest(*[F.col(s).isNull().cast("int") for s in signals], F.lit(0)) > 0).count()
    if missing:
        raise ValueError(f"{missing} rows lack a signal")
    names = {}
    for i, task in enumerate(tasks):
        on = (F.col("task") == task).cast("double")
        names[f"t{i}"] = on
        names |= {f"t{i}_{s}": on * F.col(s) for s in signals}
    return rows.withColumns(names), list(names)


def penalties_table(spark: SparkSession, search: models.Search) -> DataFrame:
    """Rows (c, log_loss, best) of a grid."""
    rows = [(c, x, c == search.best) for c, x in search.log_loss.items()]
    return spark.createDataFrame(rows, "c double, log_loss double, best boolean")


def curve_of(test: DataFrame, score: Column, budgets: list[float], target: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(the operating curve of `test` by a score, with `captured`; one row n, base_rate, roc_auc, average_precision of the score
    for the target, by default that the frontier rescues)."""
    rescue = F.col("frontier_success") & ~F.col("success")
    scored = test.withColumn("probability", score).withColumn("_target", (rescue if target is None else target).cast("double"))
    policies = {"model": lambda: F.col("probability"), "oracle": routing.POLICIES["oracle"]}
    curve = routing.operating_curve(scored.drop("_target"), policies, budgets)
    captured = routing.headroom(curve).select("policy", "budget", "captured")
    return curve.join(captured, ["policy", "budget"], "left"), metrics.ranking_report(scored, "probability", "_target")


def evaluated(train: DataFrame, test: DataFrame, columns: list[str], budgets: list[float]) -> tuple[DataFrame, DataFrame]:
    """train, test: pairs. (the operating curve of `test` under a router fitted on `train`, with `captured`; one row n, base_rate,
    roc_auc, average_precision of its scores): a model of the local failures gives each pair's score."""
    fails = lambda df: df.withColumn("_fails", (~F.col("success")).cast("double"))
    scored = features.logistic(fails(train), fails(test), columns, "_fails", balanced=True)
    return curve_of(scored.drop("_fails"), F.col("probability"), budgets, ~F.col("success"))
