"""The Merkle manifest against a plain recursion, and its defined results in odd cases."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from quartzgate.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx int, digest int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r):
    return H(*[field(r[c]) for c in merkle.COLUMNS])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([H(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return out


def path(levels, i):
    """(place, others) of each level up to the top."""
    out = []
    for nodes in levels[:-1]:
        start = i - i % 3
        group = nodes[start : start + 3]
        out.append((i - start, group[: i - start] + group[i - start + 1 :]))
        i //= 3
    return out


def fold(node, steps):
    for at, others in steps:
        node = H(*others[:at], node, *others[at:])
    return node


def plain(rows):
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    forests = []
    for s in order:
        members = sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        forests.append((members, levels_of([leaf(r) for r in members])))
    top = levels_of([f[1][-1][0] for f in forests])
    out = []
    for j, (members, levels) in enumerate(forests):
        for i, r in enumerate(members):
            steps = path(levels, i) + path(top, j)
            now = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                now["text"] = r["text"].replace("\n", "")
            root = fold(leaf(now), steps)
            proof = H(*[x for _, others in steps for x in others])
            out.append((r["doc_id"], leaf(r), levels[-1][0], top[-1][0], proof, root, root == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([tuple({**r, "tree": "t", "idx": 1, "digest": 2}.values()) for r in rows], DOCS)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.verify_tampered(docs).select(*names).collect()), key=repr)


def row(i, text, source, lang="en"):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": None if text is None else len(text)}


def test_manifest_equals_plain_recursion(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [row(i * 7 % 1009, f"text {i}\nline\n" * (i % 3), f"s{rnd.randrange(40)}" if i % 3 else "hot") for i in range(700)]
    want = plain(rows)
    assert found(spark, rows) == want
    monkeypatch.setattr(merkle, "BLOCK", 9)  # several passes, also of the tree over the sources
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "ROWS", 16)
    assert found(spark, rows) == want
    assert {r[6] for r in want} == {True, False}


def test_trees_of_all_heights(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 9)
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [row(i, f"a\n{i}", f"source of {n}") for n in (1, 2, 3, 4, 8, 9, 10, 27, 28, 81, 82) for i in range(n)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:1]) == plain(rows[:1])


def test_odd_rows(spark):
    rows = [
        row(None, "no id\n", "a"), row(None, "no id\n", "a"), row(None, None, None), row(3, None, None), row(3, "", ""), row(3, "", ""), row(4, "é\n漢\n", "é"),
        row(5, "x\n" * 200_000, "z", None), row(-6, "minus\n", "a"), row(10**15, "large\n", "Z"), row(4, "other\n", "é"),
    ]
    assert found(spark, rows + rows[:1] * 50) == plain(rows + rows[:1] * 50)
    assert merkle.verify_tampered(spark.createDataFrame([], DOCS)).collect() == []


def test_store_holds_all_levels(spark):
    rows = [row(i, str(i), f"s{i % 2}") for i in range(600)]
    docs = spark.createDataFrame([tuple({**r, "tree": "t", "idx": 1, "digest": 2}.values()) for r in rows], DOCS)
    made = merkle.manifest(docs)
    got = {(r["level"], bytes(r["tree"])[1:].decode(), r["idx"]): bytes(r["digest"]).hex() for r in made.sources.levels().collect()}
    for s in ("s0", "s1"):
        levels = levels_of([leaf(r) for r in rows if r["source"] == s])
        assert {(h, s, i): d for h, nodes in enumerate(levels) for i, d in enumerate(nodes)}.items() <= got.items()
    assert len(got) == 2 * sum(map(len, levels))
    proofs = made.proofs().where(merkle.folded(F.col("digest"), F.col("proof")) == F.col("root"))
    assert proofs.count() == 600


def test_query_equals_its_sql(spark):
    import duckdb

    from quartzgate.llm import queries

    small = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = duck.sql(queries.ORACLES["op13_merkle_manifest"])
    got = queries.QUERIES["op13_merkle_manifest"](spark, small).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) == 200
