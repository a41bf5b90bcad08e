"""Literal fixtures and invariants of the library's operators."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quartzgate.functions import spans as S
from quartzgate.functions import text as T
from quartzgate.operators import bootstrap, economics, gate, metrics, online, pii, ranking, routing, sampling
from quartzgate.sources import logs

PAIR = "pair_id string, task string, success boolean, frontier_success boolean, mean_logprob double, n_chars long"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def synthetic(spark, n=100, failures=30, fallible=False):
    rows = [(f"p{i:03d}", "ab"[i % 2], i >= failures, not fallible or i % 3 != 0, -1.0 + i / n, 10 + i) for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, PAIR)


def curve(df, **more):
    return {(r["policy"], r["budget"]): r["quality"] for r in routing.operating_curve(df, **more).collect()}


def test_curve_ends_and_oracle(spark):
    q = curve(synthetic(spark))
    assert q["confidence", 0.0] == 0.7 and q["confidence", 1.0] == 1.0
    assert q["confidence", 0.3] == q["oracle", 0.3] == 1.0


def test_oracle_bounds_every_policy_and_headroom_is_at_most_one(spark):
    df = synthetic(spark, fallible=True)
    q = curve(df)
    assert all(q["oracle", b] >= v for (_, b), v in q.items())
    assert all(r["captured"] is None or r["captured"] <= 1 for r in routing.headroom(routing.operating_curve(df)).collect())


def test_ties_fall_by_pair_id(spark):
    rows = [(f"p{i}", "a", i % 2 == 0, True, -0.5, 1) for i in range(10)]
    a = curve(spark.createDataFrame(rows, PAIR))
    b = curve(spark.createDataFrame(rows[::-1], PAIR))
    assert a == b


def test_misroutes(spark):
    gains = [1, -1, 0, 0, 1, 0, -1, 0, 0, 0]
    scores = [3, 9, 1, 8, 7, 2, 6, 0, 5, 4]
    rows = [(f"p{i}", "a", g <= 0 and (g < 0 or i % 2 == 0), g > 0 or (g == 0 and i % 2 == 0), -float(s), 1) for i, (g, s) in enumerate(zip(gains, scores))]
    rows = [(p, t, s, f, -abs(m), n) for p, t, s, f, m, n in rows]
    tagged = routing.misroutes(spark.createDataFrame(rows, PAIR), budget=0.3)
    kinds = {r["pair_id"]: r["misroute"] for r in tagged.collect()}
    assert kinds["p1"] == "harmful" and kinds["p3"] == "wasted" and kinds["p0"] == "missed" and kinds["p4"] is None
    s = routing.misroute_summary(tagged).first()
    assert s["quality"] == pytest.approx(s["quality_from_tags"])


def test_allocation(spark):
    def best(curves, total):
        rows = [(t, k, g) for t, c in curves.items() for k, g in enumerate(c)]
        return {t: k for t, (k, _) in routing.best_allocation(spark.createDataFrame(rows, "task string, rank long, cumulative long"), total).items()}

    assert best({"a": [0, 0, 5], "b": [0, 1, 2, 3]}, 2) == {"a": 2, "b": 0}
    assert best({"a": [0, 0, 5], "b": [0, 1, 2, 3]}, 3) == {"a": 2, "b": 1}
    assert best({"a": [0, -1, -2], "b": [0, 1]}, 3)["a"] == 0


def test_adjudication(spark):
    rows = [("i1", "intent", "a", "b", "a"), ("i2", "intent", "a", "b", "b"), ("i3", "intent", "a", "b", "c"), ("i4", "intent", "a", "a", None)]
    df = spark.createDataFrame(rows, "pair_id string, task string, gold string, local string, frontier string")
    assert [r["pair_id"] for r in routing.adjudicate(df).where("quarantine").collect()] == ["i2"]


def test_spans_place_parse_and_score(spark):
    parsed = one(spark, S.parse_output(F.col("t")), t="GIVENNAME: Ann\nnot a pair\nEMAIL: a@b.c\n")
    assert [tuple(p) for p in parsed] == [("GIVENNAME", "Ann"), ("EMAIL", "a@b.c")]
    place = S.place(F.col("t"), S.parse_output(F.col("p")))
    assert [tuple(s) for s in one(spark, place, t="Ann and Ann", p="NAME: Ann\nNAME: Ann")] == [(0, 3, "NAME"), (8, 11, "NAME")]
    assert one(spark, place, t="hello world", p="NAME: nobody") == []
    lost = one(spark, S.locate(F.col("t"), S.parse_output(F.col("p")))["unplaced"], t="Ann", p="A: Ann\nB: Ann\nC: Bob")
    assert [s["why"] for s in lost] == ["repeated_value", "invented"]


def spans_frame(spark, rows):
    return spark.createDataFrame(rows, f"doc long, text string, gold {S.SPANS}, predicted {S.SPANS}")


def test_strict_relaxed_and_coverage(spark):
    t = "Anna met Bob"
    df = spans_frame(spark, [(1, t, [(0, 5, "NAME")], [(0, 4, "NAME")]), (2, t, [(0, 4, "NAME")], [(0, 4, "CITY")]), (3, t, [(0, 4, "NAME")], [(0, 4, "NAME")])])
    r = pii.span_report(df, "gold", "predicted").first()
    assert (r["strict_tp"], r["relaxed_tp"], r["partly_unmasked"], r["wholly_unmasked"]) == (1, 2, 1, 0)
    kinds = {(e["doc"], e["kind"]) for e in pii.errors(df.withColumn("unplaced", F.array().cast("array<struct<label:string,value:string,why:string>>"))).collect()}
    assert kinds == {(1, "boundary"), (2, "label"), (3, "exact")}


def test_relaxed_equals_plain_greedy(spark):
    rnd = random.Random(5)
    span = lambda: (a := rnd.randrange(30), a + rnd.randint(1, 6), rnd.choice("AB"))
    rows = [(i, "x" * 40, [span() for _ in range(rnd.randint(0, 4))], [span() for _ in range(rnd.randint(0, 4))]) for i in range(150)]
    got = {r["doc"]: r["h"] for r in spans_frame(spark, rows).select("doc", S.relaxed_hits(F.col("gold"), F.col("predicted")).alias("h")).collect()}
    for doc, _, gold, predicted in rows:
        left, hits = list(gold), 0
        for p in predicted:
            g = next((g for g in left if g[2] == p[2] and g[0] < p[1] and p[0] < g[1]), None)
            if g:
                left.remove(g)
                hits += 1
        assert got[doc] == hits


def test_grouped_names_join(spark):
    t = "Ann  Lee sex"
    df = spans_frame(spark, [(1, t, [(0, 3, "GIVENNAME"), (5, 8, "SURNAME"), (9, 12, "SEX")], [])])
    got = df.select(S.grouped(F.col("text"), F.col("gold")).alias("g")).first()["g"]
    assert [tuple(s) for s in got] == [(0, 8, "NAME"), (9, 12, "SEX_OR_GENDER")]
    cut = df.select(S.redact(F.col("text"), F.col("gold"), {"SEX": "<s>"}, "<n>").alias("r"), S.remove(F.col("text"), F.col("gold")).alias("c")).first()
    assert cut["r"] == "<n>  <n> <s>" and cut["c"] == ""


def test_detector_equals_plain_loop(spark):
    texts = [
        "Mail dana@example.com or +1 555-123-4567, card 4785 3805 9239 1139.", "Born 3 March 1990 and 12/05/2001; zip 90210, id AB1234567 and X1Y2Z3W4.",
        "Dr. Who, a non-binary man (m).", "tax 12345-67890 ssn 123-45-6789 or 123.456.7890", "nothing here",
    ]
    patterns = [(k, re.compile(p.replace("(?U)", ""))) for k, p in pii.PATTERNS]
    lists = (("TITLE", pii.TITLES), ("GENDER", pii.GENDERS), ("SEX", pii.SEXES))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("s", pii.detect(F.col("text")))
    for r in df.collect():
        taken = []
        for k, p in patterns:
            for m in p.finditer(r["text"]):
                if not any(a < m.end() and m.start() < b for a, b, _ in taken):
                    taken.append((m.start(), m.end(), k))
        for k, words in lists:
            for m in re.finditer(r"\b[\w-]+\b", r["text"]):
                if m.group().lower() in words and not any(a < m.end() and m.start() < b for a, b, _ in taken):
                    taken.append((m.start(), m.end(), k))
        assert [tuple(s) for s in r["s"]] == sorted(taken)


def test_guard_and_cues(spark):
    df = spark.createDataFrame([("mail dana@example.com now", "CITY: now")], "text string, p string")
    out = df.select(pii.guard(F.col("text"), F.col("p"), pii.detect(F.col("text"))).alias("g")).first()["g"]
    assert out == "CITY: now\nEMAIL: dana@example.com"
    df = spans_frame(spark, [(1, "Gender: Male, passport no 12", [(8, 12, "SEX"), (26, 28, "IDCARDNUM")], [])])
    got = df.select(pii.relabelled(F.col("text"), F.col("gold")).alias("g")).first()["g"]
    assert [s["label"] for s in got] == ["GENDER", "PASSPORTNUM"]


def test_address_parts(spark):
    parts = lambda v: [tuple(p) for p in one(spark, pii.address_parts(F.col("v")), v=v)]
    assert parts("12a High St") == [("BUILDINGNUM", "12a"), ("STREET", "High St")]
    assert parts("High St, 12") == [("STREET", "High St"), ("BUILDINGNUM", "12")]
    assert parts("High St") == [("STREET", "High St")]


@pytest.mark.parametrize(
    ("text", "free"),
    [("I want to pay. Thanks", True), ("how do I do it? OK then", True), ("call 5", False), ("ask Bob", False), ("she left", False), ("a@b", False), ("well, I'm here", False)],
)
def test_pii_free(spark, text, free):
    assert one(spark, T.pii_free(F.col("t")), t=text) is free


def test_text_functions(spark):
    assert one(spark, T.first_line(F.col("t")), t="  \n a \n b") == "a"
    assert one(spark, T.word_count(F.col("t")), t="   ") == 0
    assert one(spark, T.token_f1(F.col("a"), F.col("b")), a="the cat the", b="The dog the") == pytest.approx(2 / 3)
    assert one(spark, T.without_placeholders(F.col("t")), t="{{Name}} [CITY_1] x") == "Name   x"
    assert one(spark, T.grounded(F.col("t"), F.col("v")), t="My card", v="M") is False
    grades = ['{"score": 4}', '{"score": "5"}', '{"score": 4.0}', '{"score": 6}', '{"score": true}', "no json", '{"score": 3.5}']
    assert [one(spark, T.judgment(F.col("r")), r=g) for g in grades] == [4, 5, 4, None, None, None, None]


def test_rank_statistics(spark):
    df = spark.createDataFrame([(float(i), float(i), float(i) + 1) for i in range(1, 6)], "a double, b double, c double")
    assert metrics.spearman(df, "a", "b").first()["spearman"] == pytest.approx(1)
    g = metrics.grade_agreement(df.where("a < 5"), "a", "c").first()
    assert (g["exact"], g["within_one"], g["bias"]) == (0, 1, 1)
    assert metrics.spearman(df.withColumn("k", F.lit(1.0)), "a", "k").first()["spearman"] is None
    p = metrics.paired_comparison(df, "a", "c").first()
    assert p["lower"] == 1 and p["w_plus"] is None
    one_class = metrics.ranking_report(df.withColumn("y", F.lit(True)), "a", "y").first()
    assert one_class["roc_auc"] is None


def test_global_ranks_equal_a_window(spark):
    rnd = random.Random(2)
    rows = [(i, float(rnd.randrange(40)) if i % 17 else None) for i in range(600)]
    got = {r["k"]: r["rank"] for r in ranking.ranked(spark.createDataFrame(rows, "k long, s double"), "s", "k").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [got[k] for k, _ in want] == list(range(1, 601))


def test_gate(spark):
    i = spark.createDataFrame([("a", "random", 0.02), ("b", "random", 0.0), ("c", "random", 0.01)], "task string, split string, spread double")
    t = spark.createDataFrame([("a", "random", 0.0039), ("b", "random", 0.0)], "task string, split string, spread double")
    d = {r["task"]: r for r in gate.thresholds(i, t).collect()}
    assert d["a"]["threshold"] == pytest.approx(0.06) and d["a"]["bound_by"] == "inference" and d["a"]["provisional"] is False
    assert d["b"]["threshold"] is None and d["c"]["provisional"] is True
    assert [r["task"] for r in gate.enforced(gate.thresholds(i, t)).collect()] == ["a"]
    v = spark.createDataFrame([(1,), (7,)], "version int")
    assert gate.next_version(v).first()["version"] == 8 and gate.next_version(v.where("version > 9")).first()["version"] == 1


def test_costs_price_a_pair_once(spark):
    assert one(spark, economics.frontier_usd(F.lit(1e6), F.lit(1e6))) == pytest.approx(0.75)
    calls = [("p1", 1, "a", 9e9, 9e9, None), ("p1", 2, "a", 1e6, 1e6, None), ("p2", 1, "a", 1e6, 1e6, "failed")]
    df = spark.createDataFrame(calls, "key string, seq int, `group` string, tokens_in double, tokens_out double, error string")
    assert economics.costs(df).where("`group` = 'a'").first()["usd"] == pytest.approx(0.75)


def test_rate_budget(spark):
    assert online.admissions([0, 0, 1, 61, 62, 86401], 2, 3) == ["granted", "granted", "minute", "granted", "day", "granted"]


def test_splits_don_t_leak(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"), (F.col("id") % 40).alias("g"))
    s = sampling.three_way(df, "k", 20, "y")
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"golden": 20, "val": 27, "train": 153}
    assert sampling.leaks(s, "k", "split").isEmpty()
    with pytest.raises(ValueError, match="divide"):
        sampling.three_way(df, "k", 21, "y")
    g = sampling.grouped_split(df, "g", "k", 10)
    assert g.where("split = 'golden'").count() == 10 and g.where("split = 'dropped'").count() == 40
    p = sampling.permuted_labels(df, "k", ["y", "g"])
    assert p.count() == 200 and p.groupBy("y").count().count() == 2 and p.where("y <> g % 2").count() == 0


def test_bootstrap_separates(spark):
    df = spark.createDataFrame([(i, 2, 0, 4) for i in range(100)], "k int, a int, b int, n int")
    r = bootstrap.ratio_difference(df, "k", "b", "a", "n", replicates=50).first()
    assert r["replicates"] == 50 and r["high"] == r["low"] == -0.5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    at = f"file://{tmp_path}/frozen"
    assert logs.freeze_or_verify(df, at, ["k"]).count() == 2
    assert logs.freeze_or_verify(df, at, ["k"]).count() == 2
    with pytest.raises(ValueError, match="frozen"):
        logs.freeze_or_verify(df.where("k = 1"), at, ["k"])
    with pytest.raises(ValueError, match="must not"):
        logs.write_verified(df, f"file://{tmp_path}/leak", df.where("k = 2"), "k")
    with pytest.raises(ValueError, match="unique"):
        logs.one_to_one(df.union(df), df, ["k"])
    assert logs.unfinished(df, df.where("k = 1"), "k").first()["k"] == 2
    (tmp_path / "log.jsonl").write_text('{"k": 1, "v": "x"}\n{"k": 1, "v": "y"}\n')
    log = logs.read_log(spark, f"file://{tmp_path}/log.jsonl", "k int, v string")
    assert logs.last_write(log, "k", "_at").first()["v"] == "y" and logs.first_write(log, "k", "_at").first()["v"] == "x"


SMALL = "/root/testdata/sf0.001"


def test_embedding_similarity_all_equals_brute_force(spark):
    import numpy as np

    from quartzgate.operators import features
    from quartzgate.plans import registry

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = dict(zip(ids.tolist(), np.sort(s, 1)[:, -5:].mean(1)))
    got = {r["id"]: r["similarity"] for r in registry.QUERIES["embedding_similarity_all"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
    e = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids.tolist(), x)] + [(-1, None), (-2, [0.0] * x.shape[1])], "id long, v array<double>")
    small = {r["id"]: r["similarity"] for r in features.nearest_vectors(e.where("id % 50 = 0 or id < 0"), e, block=150).collect()}
    assert small.keys() == {i for i in want if i % 50 == 0} and all(abs(small[i] - want[i]) < 1e-9 for i in small)


def test_char_gram_similarity_asks_every_turn(spark):
    from quartzgate.plans import registry

    turns = {tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn").collect()}
    got = registry.QUERIES["char_gram_similarity"](spark, SMALL).collect()
    assert {(r["conv_id"], r["turn"]) for r in got} == turns and len(got) == len(turns)
    assert all(0 <= r["similarity"] <= 1 + 1e-9 for r in got) and any(r["similarity"] > 0 for r in got)


def test_nearest_mean_equals_a_join_of_all_pairs(spark, monkeypatch):
    from quartzgate.operators import features

    monkeypatch.setattr(features, "COLUMNS", 7)
    r = random.Random(5)
    draw = lambda n, terms: {i: {f"t{x}": r.random() + 0.01 for x in r.sample(terms, r.randint(1, 9))} for i in range(n)}
    asked, held = draw(40, range(30)), draw(25, range(20))
    asked[99] = {"t25": 1.0}  # in no row
    want = {}
    for i, q in asked.items():
        s = sorted((sum(w * t.get(x, 0.0) for x, w in q.items()) for t in held.values()), reverse=True)
        if s[0] > 0:
            want[i] = sum(s[:5]) / 5
    rows = lambda d: spark.createDataFrame([(i, x, w) for i, t in d.items() for x, w in t.items()], "id long, term string, w double")
    for queries in (rows(asked), rows(asked).withColumn("id", F.struct("id", F.lit("x").alias("turn")))):
        got = {getattr(r["id"], "id", r["id"]): r["similarity"] for r in features.nearest_mean(queries, rows(held), block=9, asked=50).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert features.nearest_mean(rows(asked).where("id < 0"), rows(held)).count() == 0
