"""What the query reports as removed is what goes from the texts."""

from __future__ import annotations

import random

from quartzgate.llm import passages

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep int, removed string, word int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "r", 3) for i, t in texts], DOCS)


def check(spark, texts):
    """The removed spans by document, compared with the texts that stay."""
    df = frame(spark, texts)
    rows = passages.repeated_passages(df).collect()
    kept = {(r["doc_id"], r["lang"]): r["text"] for r in passages.dedup_passages(df).collect()}
    gone: dict = {}
    for r in rows:
        assert r["removed"] == (r["keep"] < r["doc_id"])
        if r["removed"]:
            gone.setdefault(r["doc_id"], []).append((r["first_word"], r["first_word"] + r["n_words"]))
    for i, t in texts:
        spans = sorted(gone.get(i, []))
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # neither overlapping nor touching
        left = [w for k, w in enumerate((t or "").split()) if not any(a <= k < b for a, b in spans)]
        if i is not None:
            assert (kept[i, "en"] or "").split() == left
    return gone, rows


def test_touching_passages_stay_in_their_keepers(spark):
    word = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    a, b = word("a", 80), word("b", 70)
    gone, rows = check(spark, [(1, a), (5, f"{a} {b}"), (9, b)])
    assert 5 in gone and sum(y - x for x, y in gone[5]) <= 80 and 1 not in gone
    assert sum(y - x for x, y in gone[9]) >= 70 - 28  # whole paragraphs go
    assert any(r["doc_id"] == 5 and not r["removed"] for r in rows)  # 5 keeps b for 9


def test_overlapping_and_nested_passages(spark):
    rnd = random.Random(11)
    stock = [f"s{i}" for i in range(400)]
    texts = []
    for i in range(40):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            at, n = rnd.randrange(300), rnd.randint(30, 100)
            parts.append(" ".join(stock[at : at + n]))  # windows of one long passage overlap and nest
            if rnd.random() < 0.5:
                parts.append(" ".join(f"own{i}_{k}" for k in range(rnd.randint(1, 30))))
        texts.append((i, rnd.choice(["\n", " ", "\n\n"]).join(parts)))
    gone, _ = check(spark, texts)
    assert len(gone) > 20


def test_odd_rows_have_defined_results(spark):
    t = " ".join(f"w{i}" for i in range(60))
    gone, rows = check(spark, [(None, t), (1, None), (2, ""), (3, t), (4, t), (7, "short")])
    assert set(gone) == {4} and {r["doc_id"] for r in rows} == {3, 4}
    assert passages.repeated_passages(frame(spark, [])).collect() == []
