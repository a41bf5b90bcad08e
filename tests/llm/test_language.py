"""Language identification against a plain coder, its accuracy, and its defined results in odd cases."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzgate.llm import language

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int"
ORDER = language.ORDER


class Coder:
    """Prediction by partial matching with exclusion, one byte at a time."""

    def __init__(self, texts):
        self.after: dict[bytes, dict[int, int]] = {}
        for t in texts:
            raw = b"\xff" * ORDER + t.encode()
            for i in range(ORDER, len(raw)):
                for order in range(ORDER + 1):
                    followers = self.after.setdefault(raw[i - order : i], {})
                    followers[raw[i]] = followers.get(raw[i], 0) + 1

    def bits(self, before, symbol):
        out, excluded = 0.0, set()
        for order in range(ORDER, -1, -1):
            seen = self.after.get(before[len(before) - order :])
            if not seen:
                continue
            offered = {s: n for s, n in seen.items() if s not in excluded}
            if offered:
                total = sum(offered.values()) + len(offered)
                if symbol in offered:
                    return out - math.log2(offered[symbol] / total)
                out -= math.log2(len(offered) / total)
            excluded |= set(seen)
        return out + math.log2(256 - len(excluded))

    def length(self, text):
        raw = b"\xff" * ORDER + text.encode()
        return sum(self.bits(raw[i - ORDER : i], raw[i]) for i in range(ORDER, len(raw)))


def counted(texts):
    keys, _ = language.grams(texts)
    return np.unique(keys, return_counts=True)


def samples(seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcé \n") for _ in range(rnd.randint(1, 60))) for _ in range(20)] + ["abababab" * 5]


@pytest.mark.parametrize("cells", [0, 40, 1 << 16])
def test_code_lengths_equal_a_plain_coder(cells):
    languages = {"x": samples(1), "y": samples(2) + ["漢字"], "z": ["q"]}
    model = language.Model({k: counted(v) for k, v in languages.items()}, cells)
    asked = [*samples(3), "", "zzz", "漢漢漢", "abab\x00q"]
    got = model.lengths(asked)
    for j, name in enumerate(model.names):
        coder = Coder(languages[name])
        assert np.allclose(got[:, j], [coder.length(t) for t in asked])


def test_each_context_shares_out_one():
    tree = language.Tree(*counted(samples(4)))
    for before in (b"abab", b"\xff\xff\xff\xff", b"zzzz", b"\xffab ", b"b\xc3\xa9a"):
        base = int.from_bytes(before, "big") << 8
        keys = np.array([base + s for s in range(256)], np.uint64)
        assert math.isclose((2 ** -tree.bits(keys)).sum(), 1, rel_tol=1e-9)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.classify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("right"), "score").collect()
    assert len(rows) > 250 and sum(r["right"] for r in rows) / len(rows) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert out.where(f"held_out <> (crc32(cast(doc_id as string)) % 3 = 1)").count() == 0


def test_odd_rows_and_no_leak(spark):
    words = {"aa": "lorem ipsum dolor sit amet ", "bb": "quick brown foxes jump over "}
    rows = [(i, words["aa" if i % 2 else "bb"] * (1 + i % 3), "aa" if i % 2 else "bb") for i in range(60)]
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, t, "wrong" if i in held else lang) for i, t, lang in rows]  # never learnt
    odd = [
        (None, words["aa"], "zz"), (100, None, "aa"), (101, "", "aa"), (102, " 12 \n!?", "bb"), (103, words["bb"] * 20_000, None), (3, rows[3][1], rows[3][2]),
        (104, "漢字", None), (105, "é", None),
    ]
    df = spark.createDataFrame([(i, t, lang, "s", 1, "x", 2) for i, t, lang in rows + odd], DOCS)
    out = language.classify(df).collect()
    assert len(out) == len(rows) + len(odd)
    pred = {r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in out}
    assert all(pred[i] == ("aa" if i % 2 else "bb", i in held) for i, _, _ in rows)
    assert pred[None] == ("aa", False) and pred[103][0] == "bb"
    assert all(pred[i][0] == "und" for i in (100, 101, 102)) and {pred[104][0], pred[105][0]} <= {"aa", "bb"}
    model = language.train(df, F.lit(True))
    kept = language.identify(df, model)
    assert sorted(kept.columns) == sorted(df.columns) and kept.where("source = 's'").count() == len(out)
    assert language.classify(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language.classify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
