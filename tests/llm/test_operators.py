"""The corpus operators against brute force, and their defined results in odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quartzgate.llm import bpe, common, fingerprints, licenses, line_dedup, nearest, ngram_join, packing, passages, quality, shingles, urls

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key int, _gone int"


def docs_frame(spark, texts):
    """Documents with columns whose names clash with internal ones."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "n", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prose(rnd, n, words=4000):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


ODD = [(None, "no id at all but text"), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "x " * 3000), (6, "Ünï cödé 漢字 😀")]


def test_line_dedup_matches_plain_rules(spark):
    rnd = random.Random(3)
    common_lines = ["  The SAME line of twenty and more ", "another repeated line of some length", "short", "é" * 19, "é" * 20]
    texts = [(i, "\n".join(rnd.choice([*common_lines, prose(rnd, 8)]) for _ in range(rnd.randint(0, 6)))) for i in range(60)] + ODD

    def key(line):
        k = lowered(line.strip(" \t\n\v\f\r"))
        return k if len(k) >= 20 else None

    held: dict[str, set] = {}
    for i, t in texts:
        if i is not None:
            for line in (t or "").split("\n"):
                if key(line):
                    held.setdefault(key(line), set()).add(i)
    keep = {k: max(v) for k, v in held.items() if len(v) >= 3}
    want = []
    for i, t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or key(x) is None or keep.get(key(x), i) == i]
        want.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    df = docs_frame(spark, texts)
    for limit in (10**6, 0):  # the broadcast table and the join
        out = line_dedup.dedup_lines(df, broadcast_rows=limit)
        got = [tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert set(df.columns) <= set(out.columns)


def test_bpe_equals_library_and_decodes(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, codec = Tokenizer.from_file(path), bpe.Codec(path)
    rnd = random.Random(1)
    letters = "aabbccdee  \n\t'sétß漢😀́\x1c\x85 \x00'll're 1234²!?#<|endoftext|>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120))) for _ in range(300)] + ["a" * 3000, "", "<|endoftext|>x", "\n\n  a"]
    for text, ids in zip(texts, codec.encode_batch(texts)):
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == tok.decode(want, skip_special_tokens=False)
    rows = {(r["doc_id"], r["n_tokens"]) for r in bpe.encode_decode(docs_frame(spark, ODD), path).collect()}
    assert (1, 0) in rows and (2, 0) in rows and any(i is None for i, _ in rows)


def test_packing_places_every_piece_without_gaps(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rnd = random.Random(5)
    texts = [(i, prose(rnd, rnd.choice([3, 40, 200, 900]))) for i in range(60)] + ODD + [(77, prose(rnd, 3000))]
    rows = packing.pack_documents(docs_frame(spark, texts), path).collect()
    want = Counter()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_subset_sum_is_the_fullest():
    rnd = random.Random(2)
    for _ in range(60):
        counts = {rnd.randint(1, 40): rnd.randint(1, 3) for _ in range(5)}
        room = rnd.randint(1, 90)
        sums = {0}
        for k, c in counts.items():
            sums = {s + k * n for s in sums for n in range(c + 1)}
        chosen = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in Counter(chosen).items())


def components(sets, num, den):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            i = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join_equals_all_pairs(spark, k, num):
    rnd = random.Random(num)
    texts = []
    for _ in range(12):
        base = prose(rnd, rnd.choice([2, 5, 9, 30, 120])).split()
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(99)}"
            texts.append((len(texts) + 10, " ".join(copy)))
    texts += [(1, None), (2, ""), (3, "Same WORDS here"), (4, "same words\there"), (5, "z " * 4000)]

    def grams(t):
        w = lowered(t).split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = {i: grams(t) for i, t in texts}
    want = components(sets, num, 100)
    got = ngram_join.join(docs_frame(spark, [*texts, (None, "same words here")]), k, num, 100).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, len(sets[i]), want[i]) for i in sets}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_linked_sets_share_a_key():
    rnd = np.random.default_rng(0)
    for n in [1, 2, 6, 7, 8, 20, 100, 700]:
        for _ in range(20):
            s = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
            differ = int(rnd.integers(0, n * 15 // 85 + 1))
            t = np.unique(np.concatenate([s[differ:], rnd.integers(0, 2**63, int(rnd.integers(0, differ + 1))).astype(np.uint64)]))
            i = len(np.intersect1d(s, t))
            if len(t) and 100 * i >= 85 * (len(s) + len(t) - i):
                keys = [set(ngram_join.set_keys([x], 85, 100)[0].tolist()) for x in (s, t)]
                assert keys[0] & keys[1]


def test_keep_one_keeps_the_smallest(spark):
    rnd = random.Random(8)
    base = prose(rnd, 60)
    df = docs_frame(spark, [(3, base), (1, base + " more"), (2, prose(rnd, 60)), (None, base), (9, None)])
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 9, None], key=repr)


def test_repeated_passages_are_found_wherever_they_start(spark):
    rnd = random.Random(4)
    passage, short = prose(rnd, 70), prose(rnd, 20)
    texts = [(i, prose(rnd, rnd.randint(80, 160))) for i in range(20)]
    for i, at in ((3, 5), (7, 61), (11, 33)):
        w = texts[i][1].split()
        texts[i] = (i, " ".join([*w[:at], passage, *w[at:]]))
    for i in (2, 5):
        texts[i] = (i, f"{texts[i][1]}\n{short}")
    df = docs_frame(spark, [*texts, *[(i + 100 if i is not None else None, t) for i, t in ODD]])
    rows = passages.repeated_passages(df).where("doc_id < 100").collect()
    assert {r["doc_id"] for r in rows} == {3, 7, 11}
    assert {r["doc_id"] for r in rows if r["removed"]} == {7, 11}
    assert all(36 <= r["n_words"] <= 70 for r in rows)
    out = {r["doc_id"]: r for r in passages.dedup_passages(df).where("doc_id < 100").collect()}
    for i, text in texts:
        assert out[i]["n_chars"] == len(out[i]["text"])
        if i in (7, 11):
            assert passage not in out[i]["text"] and len(out[i]["text"].split()) >= len(text.split()) - 70
        else:
            assert out[i]["text"] == text


def test_paragraphs_align_in_any_shared_run():
    rnd = random.Random(6)
    for _ in range(30):
        shared = prose(rnd, 50)
        a, b = (f"{prose(rnd, rnd.randint(0, 80))} {shared} {prose(rnd, rnd.randint(0, 80))}" for _ in range(2))
        p, q = passages.Paragraphs([a]), passages.Paragraphs([b])
        assert set(p.nodes().tolist()) & set(q.nodes().tolist())


def test_paragraphs_align_where_a_phrase_recurs():
    rnd = random.Random(12)
    for period in range(1, 16):
        for _ in range(60):
            head = [f"h{rnd.randrange(9)}" for _ in range(min(period, 3))]
            row = lambda: [*head, *(f"w{rnd.randrange(10**6)}" for _ in range(period - len(head)))]
            rows = lambda n: [w for _ in range(-(-n // period)) for w in row()]
            if period == 1:  # one word again and again, within the shared run or beyond its ends
                edge = [f"w{rnd.randrange(10**6)}" for _ in range(50)]
                at, n = rnd.randrange(50), rnd.randrange(51)
                shared = [*edge[:at], *head * n, *edge[at:]][:50]
            else:
                shared = rows(50)[:50]
            a, b = (" ".join([*rows(rnd.randint(0, 400)), *shared, *rows(rnd.randint(0, 400))]) for _ in range(2))
            p, q = passages.Paragraphs([a]), passages.Paragraphs([b])
            assert set(p.nodes().tolist()) & set(q.nodes().tolist()), (period, shared)
    assert len(passages.Paragraphs(["x " * 3000]).at) < 250


def test_edited_natural_paragraphs_are_found(spark):
    rnd = random.Random(21)
    texts, pairs = [], 60
    sizes = [rnd.choice([100, 100, 160, 400]) for _ in range(pairs)]
    for i, n in enumerate(sizes):
        line = prose(rnd, n).split()
        other = list(line)
        for k in range(n // 50):  # a changed word in each 50 leaves Jaccard 0.81 and no run of 50
            other[33 * (k + 1) if n == 100 else 25 + 50 * k] = "edited"
        wrapped = "\n".join([" ".join(other[:20]), " ".join(other[20:])])
        source = "\n".join([" ".join(line[:70]), " ".join(line[70:])])
        inner = i % 2 == 1  # a line, or lines between blank ones
        texts.append((i, f"{prose(rnd, 30)}\n\n{source}\n \n{prose(rnd, 9)}" if inner else f"{prose(rnd, 30)}\n{' '.join(line)}\nend"))
        texts.append((1000 + i, f"{prose(rnd, 20)}\n\n{wrapped}\n\nlast words" if inner else f"{' '.join(other)}\n{prose(rnd, 25)}"))
    texts.append((5000, "\n".join(prose(rnd, 40) for _ in range(5))))
    df = docs_frame(spark, texts)
    rows = passages.repeated_passages(df).collect()
    found = {r["doc_id"]: r for r in rows if r["removed"]}
    hit = []
    for i, n in enumerate(sizes):  # a passage cut by content may reach a few words beyond the paragraph
        r, at = found.get(1000 + i), 20 * (i % 2)
        if r and r["keep"] == i and at - 4 < r["first_word"] <= at and at + n <= r["first_word"] + r["n_words"] < at + n + 8:
            hit.append(i)
    assert len(hit) >= 0.95 * pairs
    assert all(r["doc_id"] < 2000 for r in rows) and all(r["keep"] == r["doc_id"] for r in rows if r["doc_id"] < 1000)
    out = {r["doc_id"]: r["text"].split() for r in passages.dedup_passages(df).collect()}
    text = dict(texts)
    for i in hit:
        assert len(out[1000 + i]) == len(text[1000 + i].split()) - found[1000 + i]["n_words"] and out[i] == text[i].split()


def test_edited_passages_inside_lines_are_found(spark):
    rnd = random.Random(31)
    texts, pairs = [], 80
    for i in range(pairs):
        passage = prose(rnd, rnd.randint(200, 400), 10**6).split()
        other = list(passage)
        for k in range(25, len(other), 50):  # no 50 words in a row are left as they were
            other[k] = "edited"
        texts += [(i, f"{prose(rnd, 40)} {' '.join(passage)} {prose(rnd, 30)}"), (1000 + i, f"{prose(rnd, 90)} {' '.join(other)} {prose(rnd, 60)}")]
    texts += [(5000 + i, prose(rnd, 300, 10**6)) for i in range(40)]
    rows = passages.repeated_passages(docs_frame(spark, texts)).collect()
    assert {r["doc_id"] for r in rows if r["removed"]} <= set(range(1000, 1000 + pairs))
    assert len({r["doc_id"] for r in rows if r["removed"] and r["keep"] == r["doc_id"] - 1000}) >= 0.9 * pairs


def test_clusters_hold_all_pairs_of_long_and_natural_paragraphs(spark):
    """Against all pairs: of the paragraphs at Jaccard 0.8 or more, at least 0.98 are in one cluster, and none else."""
    rnd = random.Random(17)
    texts = []
    for i in range(25):
        lines = [prose(rnd, rnd.choice([40, 60, 110]), 10**6).split() for _ in range(3)]
        for c in range(3):
            copy = [list(x) for x in lines]
            for x in copy:
                for _ in range(rnd.randint(0, 3)):
                    x[rnd.randrange(len(x))] = f"e{rnd.randrange(10**6)}"
            texts.append((10 * i + c, "\n".join(" ".join(x) for x in copy)))
    texts.append((900, texts[0][1]))
    p = passages.Paragraphs([t for _, t in texts])
    cut = np.where(p.group == p.LONGS, passages.MARGIN, 0)
    places = {i: (texts[p.owner[i]][0], int(p.word[i] + cut[i]), int(p.size[i] - 2 * cut[i])) for i in np.flatnonzero(p.banded).tolist()}
    sets = {i: set(p.set_of(i).tolist()) for i in places}
    rows = passages.occurrences(docs_frame(spark, texts)).where(f"words <> {passages.LENGTH}").collect()
    got = {(r["doc_id"], r["word"], r["words"]): r["cluster"] for r in rows}
    assert {k[0] for k in got} <= {k[0] for k in places.values()} and len(got) > 50
    cluster = {i: got.get(k) for i, k in places.items()}
    near, hit = 0, 0
    for a in sets:
        for b in sets:
            if places[a][0] < places[b][0] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                if sets[a] == sets[b] and p.group[a] == p.LONGS:  # their short ones meet word for word
                    continue
                near += 1
                hit += cluster[a] is not None and cluster[a] == cluster[b]
    assert near > 50 and hit >= 0.98 * near
    mates = components(sets, 80, 100)
    for a in sets:
        for b in sets:
            assert cluster[a] is None or cluster[a] != cluster[b] or mates[a] == mates[b]


def test_postings_share_the_same_in_small_and_large_buffers(monkeypatch):
    from quartzgate.llm import postings

    rnd = np.random.default_rng(4)
    key = shingles.mix(rnd.integers(0, 400, 3000).astype(np.uint64))
    owner = rnd.integers(0, 900, 3000)
    word = np.arange(3000, dtype=np.int32)
    owners: dict[int, set] = {}
    for k, o in zip(key.tolist(), owner.tolist()):
        owners.setdefault(k, set()).add(o)
    want = sorted((k, o, w) for k, o, w in zip(key.tolist(), owner.tolist(), word.tolist()) if len(owners[k]) > 1)
    for most in (50, 700, 10**6):
        monkeypatch.setattr(postings, "SORTED", most)
        sender, got, linked = postings.Sender(1, 8), [], {}
        receiver = postings.Receiver([np.uint64, np.int64, np.int32], once=False)
        batches = [b for i in range(0, 3000, 100) for b in (*sender.add(key[i : i + 100], owner[i : i + 100], word[i : i + 100]), *sender.flush())]
        rows = [r for b in batches for r in b.to_pylist()]
        for found in [*(f for r in rows for f in receiver.add(r["n"], r["packed"])), *receiver.finish()]:
            k, o, w = found.columns
            got += [(a, b, c) for a, b, c, old in zip(k.tolist(), o.tolist(), w.tolist(), found.old) if not old]
            for at, n in zip(found.first.tolist(), found.sizes.tolist()):
                linked.setdefault(int(k[at]), []).append(set(o[at : at + n].tolist()))
        assert sorted(got) == want
        for k, groups in linked.items():  # what left in several parts hangs together by one owner
            reached = groups[0]
            for g in groups[1:]:
                assert reached & g
                reached = reached | g
            assert reached == owners[k]


def test_nearest_neighbours_recall_and_odd_vectors(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 24)) * rnd.uniform(0.5, 2, (3000, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] + [1.0] * 23), (9004, [float("inf")] * 24), (9005, [None] + [1.0] * 23), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    clean = nearest.clean(df)
    got = nearest.search(clean, clean.where("vec_id % 20 = 0")).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20]
        g = g.sort_values("rank")
        hit += len(set(want) & set(g.vec_id))
        assert g["rank"].tolist() == list(range(1, 21)) and (np.diff(g.score) <= 0).all()
        assert np.allclose(g.score, [s[v] for v in g.vec_id])
    assert hit / (20 * got.query_id.nunique()) >= 0.9
    few = nearest.clean(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r)[:3] for r in nearest.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert nearest.search(few.where("vec_id < 0"), few.where("vec_id < 0")).count() == 0


def test_nearest_neighbours_with_repeats_and_mixed_dimensions(spark):
    rnd = np.random.default_rng(5)
    one = [float(c) for c in rnd.normal(size=7)]
    rows = [(i, one) for i in range(40)] + [(100 + i, [float(c) for c in rnd.normal(size=7)]) for i in range(30)]
    rows += [(200, [1.0, 2.0]), (201, [3.0] * 9), (100, rows[45][1])]
    clean = nearest.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = nearest.search(clean, clean.where("vec_id = 0 or vec_id = 200")).orderBy("rank").collect()
    assert {r["query_id"] for r in got} == {0} and len(got) == 20
    ties = [r["vec_id"] for r in got if r["score"] == got[0]["score"]]
    assert ties == sorted(ties) and ties[:19] == list(range(1, 20))


def test_footrule_by_lists_equals_the_definition():
    rnd = np.random.default_rng(3)
    pivots, x, q = rnd.normal(size=(12, 5)), rnd.normal(size=(40, 5)), rnd.normal(size=(3, 5))
    prefix, k = 6, 8
    ids = np.arange(40)
    got = nearest.search_block(ids, x, np.array([100, 101, 102]), q, pivots, 9.0, prefix, 0.1, 8, k)
    lifted = nearest._lifted(pivots, 9.0)
    mine = nearest.order(nearest._lifted(x, 9.0), lifted, prefix)
    theirs = nearest.order(np.column_stack([q, np.zeros(3)]), lifted, prefix)
    for i, query in enumerate((100, 101, 102)):
        place = lambda o, p: o.tolist().index(p) if p in o else prefix
        d = [sum(abs(place(m, p) - place(theirs[i], p)) for p in range(12)) for m in mine]
        nearest8 = set(np.lexsort((ids, d))[:8].tolist())
        assert set(got[1][got[0] == query].tolist()) == nearest8


def test_fingerprints_estimate_weighted_jaccard(spark):
    rnd = random.Random(9)
    texts = [(i * 37, prose(rnd, 200, 300)) for i in range(80)] + [(5000, "same text here"), (5001, "same text here"), (1, None), (3, "  "), (None, "no id")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs_frame(spark, texts)).collect()}
    order = sorted((i for i, _ in texts if i is not None), reverse=True)
    text = {i: t or "" for i, t in texts}
    ring = [*order, None]

    def jaccard(a, b):
        a, b = (Counter(x.lower().split()) for x in (a, b))
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    errors = []
    for at, i in enumerate(ring):
        after = text[ring[(at + 1) % len(ring)]]
        cut = len(text[i]) // 3
        edited = text[i][: len(text[i]) - cut] + after[:cut]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(text[i])
        errors.append(got[i]["near_edited"] - jaccard(text[i], edited))
    assert abs(np.mean(errors)) < 0.06 and np.sqrt(np.mean(np.square(errors))) < 0.15
    assert got[5000]["fingerprint"] == got[5001]["fingerprint"] != got[0]["fingerprint"]
    assert got[5001]["near_next"] == 1.0
    assert fingerprints.fingerprints(docs_frame(spark, [])).count() == 0


def test_license_base_phrases_and_templates(spark):
    mit = licenses.TEMPLATES["mit"].replace("[[ the software ]]", "(the Software),").replace("[[ including the next paragraph ]]", "")
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    texts = [
        (0, "a Released under the MIT License. under THE mit license"), (1, mit.upper()), (2, gpl), (3, None), (4, ""),
        (5, "under the mit licenses, cc by-nc 4.0, Apache License, Version 2.0"), (6, "permission is hereby granted free of charge to nobody"),
        (7, "under the mit under the mit license"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(docs_frame(spark, texts)).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (2, 2, 6, "mit")
    assert got[1]["labels"] == "mit" and got[1]["base_labels"] == "" and got[1]["score"] == 1.0
    assert got[2]["labels"] == "gpl"
    assert (got[3]["n_words"], got[3]["first_word"], got[3]["labels"], got[3]["score"]) == (0, None, "", 0.0)
    assert got[5]["base_labels"] == "apache-2,cc-by-nc" and got[5]["first_word"] == 4
    assert got[6]["labels"] == "" and 0 < got[6]["score"] < 1
    assert (got[7]["n_base"], got[7]["first_word"]) == (1, 3)


def test_license_variants_are_told_apart(spark):
    texts = [
        (0, "licensed under the GNU Lesser General Public License, version 3"), (1, "licensed under the GNU Affero General Public License v3"),
        (2, "Licensed under the GNU General Public License version 2"), (3, "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
        (4, "licensed under a Creative Commons Attribution-NoDerivatives license"), (5, "licensed under a Creative Commons Attribution 4.0 license"),
        (6, licenses.TEMPLATES["mit"].replace("[[ the software ]]", "").replace("[[ including the next paragraph ]]", "").split("the software is provided as is")[0]),
        (7, "licensed under cc by nc"), (None, "licensed under cc by nc"), (7, "licensed under cc by nc"), (8, "word " * 200_000 + "cc by nc"),
    ]
    got = {}
    for r in licenses.scan(docs_frame(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append(r["labels"])
    assert got == {0: ["lgpl"], 1: ["agpl"], 2: ["gpl"], 3: ["cc-by-sa"], 4: ["cc-by-nd"], 5: ["cc-by"], 6: [""], 7: ["cc-by-nc"] * 2, None: ["cc-by-nc"], 8: ["cc-by-nc"]}


def _template_pattern(markup):
    """A template as a regular expression over words that are followed by one space each."""
    out = ""
    for token in markup.split():
        if token == "[[":
            out += "(?:"
        elif token == "]]":
            out += ")?"
        elif token.startswith("{{"):
            low, high = token.strip("{}#").split("-")
            out += ("(?:[0-9]+ )" if "#" in token else "(?:[^ ]+ )") + "{%s,%s}?" % (low, high)
        else:
            out += token + " "
    return re.compile("(?<![^ ])" + out)


def test_license_scan_equals_brute_force(spark):
    rnd = random.Random(23)
    patterns = [(k.removesuffix("-notice"), _template_pattern(v)) for k, v in licenses.TEMPLATES.items()]

    def example(markup):
        words, depth = [], []
        for token in markup.split():
            if token == "[[":
                depth.append(rnd.random() < 0.5)
            elif token == "]]":
                depth.pop()
            elif all(depth):
                if token.startswith("{{"):
                    low, high = map(int, token.strip("{}#").split("-"))
                    words += [rnd.choice("3 4 5".split()) for _ in range(rnd.randint(low, high))]
                else:
                    words.append(token)
        return words

    texts = []
    for i in range(400):
        words = prose(rnd, rnd.randint(0, 20), 50).split() + example(rnd.choice(list(licenses.TEMPLATES.values())))
        words += rnd.choice(list(licenses.PHRASES)).split() if rnd.random() < 0.3 else []
        if rnd.random() < 0.4 and words:
            words[rnd.randrange(len(words))] = rnd.choice(["the", "software", "x"])
        texts.append((i, "".join(w + rnd.choice([" ", "\n", ", ", " - "]) for w in words)))
    got = {r["doc_id"]: r for r in licenses.scan(docs_frame(spark, texts)).collect()}
    for i, text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        line = "".join(w + " " for w in words)
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        base = {label for _, label in places}
        more = {label for label, pattern in patterns if pattern.search(line)}
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | more)), text


def test_template_automaton_equals_enumeration():
    rnd = random.Random(0)
    t = licenses.Template("t", "a b [[ c [[ d ]] ]] {{0-2}} e")
    for _ in range(400):
        tail = [rnd.choice("cdex") for _ in range(rnd.randint(0, 6))]
        want = re.match(r"^(c(d)?)?([cdex]){0,2}?e", "".join(tail)) is not None
        assert (t.run([x.encode() for x in tail]) == 1.0) == want


def test_url_rules_and_model(spark):
    rnd = random.Random(1)
    name = lambda letters: "".join(rnd.choice(letters) for _ in range(9))
    rows = [(i, f"https://{name('aeiou')}.example.org/en/{name('aeiou')}") for i in range(120)]
    rows += [(200 + i, f"http://m.{name('xyzqk')}.example.com/de/{name('xyzqk')}") for i in range(120)]
    rows += [(500 + i, f"http://{name('aeiou')}.example.net/{name('aeiou')}") for i in range(40)]
    rows += [(600 + i, f"http://{name('xyzqk')}.example.net/{name('xyzqk')}") for i in range(40)]
    odd = {900: None, 901: "no scheme", 902: "HTTPS://EXAMPLE.org/es/x?q#f", 903: "http://badexample.org/es/", 904: "http://a.example.org/en/19", 905: "http://a.com?x"}
    df = spark.createDataFrame(rows + list(odd.items()), "page_id long, url string").selectExpr("*", "1 AS verdict", "'x' AS rule")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert (got[900]["host"], got[900]["path"], got[900]["rule"]) == ("", "", None) == (got[901]["host"], got[901]["path"], got[901]["rule"])
    assert (got[902]["host"], got[902]["path"], got[902]["rule"], got[902]["verdict"]) == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[903]["rule"] == "org/" and got[904]["rule"] == "example.org/en/1" and got[905]["path"] == ""
    assert np.mean([got[500 + i]["verdict"] == "allow" for i in range(40)]) >= 0.9
    assert np.mean([got[600 + i]["verdict"] == "block" for i in range(40)]) >= 0.9
    assert urls.judge(df.where("page_id < 0")).count() == 0


def test_url_scores_equal_plain_counts_of_all_labels(spark):
    rnd = random.Random(7)
    name = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789-é") for _ in range(n))
    rows = [(i, f"https://{name(9)}.example.org/en/{name(20)}") for i in range(1500)]
    rows += [(2000 + i, f"http://{name(9)}.example.com/de/{name(20)}") for i in range(1500)]
    rows += [(5000 + i, f"http://{name(9)}.example.net/{name(20)}") for i in range(60)]
    rows += [(7000, rows[0][1]), (7001, rows[-1][1])]
    seen: dict[str, Counter] = {"allow": Counter(), "block": Counter()}
    grams = lambda u: [(o, ("\0" * 5 + u)[i + 5 - o : i + 5], u[i]) for i in range(len(u)) for o in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    free = [(i, u) for i, u in rows if got[i]["rule"] is None]
    for i, u in rows:
        if got[i]["rule"] is not None:
            for o, context, c in grams(u):
                seen[got[i]["verdict"]][o, context, c] += 1
                seen[got[i]["verdict"]][o, context] += 1
    assert len(seen["allow"]) > 3 * 32768 and len(free) == 61
    for i, u in free:
        gain, p = 0.0, {}
        for o, context, c in grams(u):
            for verdict, n in seen.items():
                p[verdict] = (n[o, context, c] + urls.BACKOFF * (p[verdict] if o else 1 / 256)) / (n[o, context] + urls.BACKOFF)
            gain += np.log(p["allow"] / p["block"]) if o == 5 else 0
        assert np.isclose(got[i]["score"], gain / len(u))


def test_quality_marginals_equal_enumeration():
    rnd = np.random.default_rng(2)
    e, step, counts = rnd.normal(size=7), rnd.normal(size=(2, 2)), np.array([4, 1, 2])
    good, pairs, z = quality.marginals(e, step, counts)
    at, want_pairs = 0, np.zeros((2, 2))
    for c, own_z in zip(counts, z):
        paths = [[(p >> i) & 1 for i in range(c)] for p in range(2**c)]
        w = np.array([np.exp(sum(e[at + i] for i in range(c) if p[i]) + sum(step[p[i], p[i + 1]] for i in range(c - 1))) for p in paths])
        assert np.isclose(np.log(w.sum()), own_z)
        for i in range(c):
            assert np.isclose(good[at + i], sum(x for x, p in zip(w, paths) if p[i]) / w.sum())
        for x, p in zip(w / w.sum(), paths):
            for i in range(c - 1):
                want_pairs[p[i], p[i + 1]] += x
        at += c
    assert np.allclose(pairs, want_pairs)


def test_quality_learns_without_the_held_out_fifth(spark):
    rnd = random.Random(3)
    rows, marks = [], []
    for i in range(300):
        good = i % 3 != 0
        line = lambda: prose(rnd, 12).capitalize() + "." if good else " ".join([rnd.choice(["BUY!!", "$$$", "###"])] * 9)
        rows.append((i, "\n".join(line() for _ in range(rnd.randint(1, 6)))))
        marks.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (None, "Plain words."), (0, rows[0][1])]
    labels = spark.createDataFrame([*marks, (None, 1), (7, None)], "doc_id long, quality int")
    got = quality.classify(docs_frame(spark, rows), labels).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    truth = dict(marks)
    held = got[got["held_out"] & got["doc_id"].isin(list(truth))]
    assert (held["predicted"] == held["doc_id"].map(truth)).mean() > 0.95
    assert (held["doc_id"].map(lambda i: zlib.crc32(str(int(i)).encode()) % 5) == 0).all()
    kept = quality.keep_good(docs_frame(spark, rows), labels)
    assert kept.columns == docs_frame(spark, rows).columns
    assert quality.train(docs_frame(spark, rows), labels.where("quality = 1")) is None


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, None)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[200] == 200
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark):
    empty = docs_frame(spark, [])
    path = public_tokenizers.path("word_bpe_49k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (
        line_dedup.dedup_lines(empty), packing.pack_documents(empty, path), ngram_join.join(empty), passages.repeated_passages(empty),
        passages.dedup_passages(empty), licenses.scan(empty), quality.classify(empty, labels), bpe.encode_decode(empty, public_tokenizers.path("byte_bpe_50k.json")),
    ):
        assert out.count() == 0


def test_words_match_plain_split():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB é\n\t\x0b ") for _ in range(30)) for _ in range(50)] + [None, ""]
    counts = shingles.words(texts)[3].tolist()
    assert counts == [len([w for w in re.split(r"[ \t\n\x0b\x0c\r]+", t or "") if w]) for t in texts]
    same = shingles.words(["Foo bar", "foo BAR"])[0]
    assert same[0] == same[2] and same[1] == same[3] and same[0] != same[1]
