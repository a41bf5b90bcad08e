"""Periodic runs against brute force, and their defined results in odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np

from quartzgate.llm import periods

DOCS = "doc_id long, text string, lang string, source string, n_chars long, runs int, best int, start string, collapsed int"


def brute(words):
    """All stretches by their definition."""
    n, out = len(words), []
    for q in range(1, n + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            part = words[start : start + length]
            if length >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out)


def brute_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def sequences(rnd, count):
    for _ in range(count):
        n, kinds = rnd.randint(0, 120), rnd.choice([1, 2, 3, 5, 40])
        words = [rnd.randrange(kinds) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):  # plant runs, also nested and touching ones
            at, q = rnd.randint(0, n), rnd.randint(1, 9)
            unit = [rnd.randrange(kinds) for _ in range(q)]
            words[at:at] = (unit * 9)[: rnd.randint(3 * q, 8 * q)]
        yield words


def test_runs_equal_brute_force():
    rnd = random.Random(2)
    for words in sequences(rnd, 400):
        assert periods.runs(np.array(words, np.int32)) == brute(words), words
    fibonacci, before = "ab", "a"
    while len(fibonacci) < 300:
        fibonacci, before = fibonacci + before, fibonacci
    for text in (fibonacci, "aab" * 40 + "aba" * 30, "abcabcabcabc" * 10 + "d" + "abc" * 9):
        words = [ord(c) for c in text]
        assert periods.runs(np.array(words, np.int32)) == brute(words)


def test_lag_counts_are_exact_for_heavy_and_light_words():
    rnd = np.random.default_rng(1)
    for kinds, n in ((1, 3000), (3, 5000), (400, 20_000), (20_000, 20_000)):
        ids = (kinds * rnd.random(n) ** 4).astype(np.int32)
        most = n // 4
        want = [0] + [int((ids[q:] == ids[:-q]).sum()) for q in range(1, most + 1)]
        assert periods.lag_counts(ids, most).tolist() == want
    assert all(periods._fft_size(n) >= n for n in range(1, 5000))


def test_islands_equal_a_full_scan():
    rnd = np.random.default_rng(4)
    for _ in range(80):
        ids = rnd.integers(0, rnd.integers(1, 4), rnd.integers(1, 80)).astype(np.int32)
        for lag in range(1, len(ids)):
            for least in (1, 2, 3, 7):
                same = np.concatenate([[0], (ids[lag:] == ids[:-lag]).astype(int), [0]])
                begin, end = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
                want = [[b, e - b] for b, e in zip(begin, end) if e - b >= least]
                assert periods.islands(ids, lag, least).tolist() == want


def test_query_rows_equal_brute_force(spark):
    rnd = random.Random(7)
    texts = [(i, rnd.choice([" ", "\n", "\t  "]).join(f"w{w}" for w in words)) for i, words in enumerate(sequences(rnd, 250))]
    texts += [
        (None, "a " * 20), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "x y " * 3000), (6, "Ünï cödé 漢 字 😀 " * 6),
        (7, "a a a a a"), (8, "a a a a a a"), (9, "A a A a A a A a\x0bA\x1ca"), (20, "p q r " * 4 + "s"),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 1, 2, "b", 3) for i, t in texts], DOCS)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in periods.digests(df).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(*t) for t in texts), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts if i is not None) > 10
    own = periods.find_runs(df)
    assert set(own.columns) == set(df.columns) and own.where("lang = 'en' and start = 'b'").count() == len(texts)
    assert own.where("doc_id = 20 and collapsed = 'p q r s'").count() == 1
    assert periods.digests(df.limit(0)).collect() == []


def test_long_texts_take_no_square_of_their_length():
    rnd = np.random.default_rng(3)
    began = time.time()
    words = (3000 * rnd.random(100_000) ** 3).astype(np.int32)
    words[30_000:60_000] = np.tile(words[:3000], 10)
    assert (30_000, 30_000, 3000) in [(s - s % 10_000, length - length % 10_000, q) for s, length, q in periods.runs(words)]
    assert periods.runs(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]
    assert periods.runs(np.tile([1, 2, 3], 50_000).astype(np.int32)) == [(0, 150_000, 3)]
    assert len(periods.runs(rnd.integers(0, 2, 30_000).astype(np.int32))) > 300
    assert time.time() - began < 60
