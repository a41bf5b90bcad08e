"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Each line is described by character and word statistics, its own and those of the lines before and
after. Training takes whole documents whose label every line inherits, from a bounded sample of the
labelled rows. A document's score is the mean of its lines' forward-backward marginals, weighted by
length, so a few bad lines in a clean document weigh little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents that training takes at most: those with the smallest hashes of their id.
TRAIN_DOCS = 4000
#: Lines that one training sequence holds at most; longer documents become several sequences.
TRAIN_LINES = 64
#: Lines of one training document at most, in stretches of TRAIN_LINES.
MOST_LINES = 1024
STEPS, RATE, PENALTY = 250, 0.08, 1e-3
#: Score from which on a document is predicted to be good.
THRESHOLD = 0.3
#: Statistics of one line.
FEATURES = 15
SYMBOLS = "#$%&*|~^=<>_@{}[]\\/`+"


def _classes() -> np.ndarray:
    """For each code point below 65536: bit 0 letter, 1 upper case, 2 digit, 3 symbol, 4 `!`, 5 `|`, 6 sentence mark, 7 blank."""
    table = np.zeros(65536, np.uint8)
    for c in range(65536):
        ch = chr(c)
        table[c] = (
            ch.isalpha() | ch.isupper() << 1 | ch.isdigit() << 2 | (ch in SYMBOLS) << 3 | (ch == "!") << 4
            | (ch == "|") << 5 | (ch in ".,;:?") << 6 | ch.isspace() << 7
        )
    return table


_TABLE: list[np.ndarray] = []


def line_statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics of each line, its length, number of lines of each text), whole texts end to end."""
    if not _TABLE:
        _TABLE.append(_classes())
    counts = np.array([t.count("\n") + 1 for t in texts])
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    kind = _TABLE[0][np.minimum(codes, 65535)]

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[ends] - total[starts]).astype(float)

    letters, upper, digits, symbols, shouts, pipes, marks = (per_line(kind >> k & 1) for k in range(7))
    blank = (kind >> 7).astype(bool)
    solid = size - per_line(blank)
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    line_of = np.searchsorted(ends, begins)
    words = np.bincount(line_of, minlength=len(ends)).astype(float)
    repeats = distinct = pairs = np.zeros(len(ends))
    if len(begins):
        at = np.arange(len(codes)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(codes)]]))) if begins[0] == 0 else None
        if at is None:
            at = np.arange(len(codes))
            at[begins[0] :] -= np.repeat(begins, np.diff(np.concatenate([begins, [len(codes)]])))
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * (np.uint64(2) * (at.astype(np.uint64) & np.uint64(63)) + np.uint64(0x9E3779B97F4A7C15))
        mixed ^= mixed >> np.uint64(31)
        mixed[blank] = 0
        word = np.add.reduceat(mixed, begins)
        same_line = line_of[1:] == line_of[:-1]
        repeats = np.bincount(line_of[1:][same_line & (word[1:] == word[:-1])], minlength=len(ends)).astype(float)
        distinct = _distinct(line_of, word, len(ends))
        pair = word[1:] * np.uint64(0xD6E8FEB86659FD93) + word[:-1]
        pairs = _distinct(line_of[1:][same_line], pair[same_line], len(ends))
    some, many = np.maximum(solid, 1), np.maximum(words, 1)
    last = kind[np.maximum(ends - 1, 0)]
    first = kind[starts]
    stats = np.stack(
        [
            np.log1p(size) / 8, letters / some, upper / np.maximum(letters, 1), digits / some, symbols / some,
            np.minimum(shouts / many, 2), np.minimum(pipes / many, 1), np.minimum(marks / many, 1), distinct / many,
            repeats / many, pairs / many, np.minimum(some / many, 30) / 10, np.log1p(words) / 6,
            (size > 0) * ((last >> 6 & 1) | (last >> 4 & 1)), (size > 0) * (first >> 1 & 1),
        ],
        1,
    )
    return stats, size, counts


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each owner has; owners are ascending."""
    if not len(value):
        return np.zeros(n)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])])
    return np.bincount(o[new], minlength=n).astype(float)


def with_neighbours(stats: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's statistics, those of the lines before and after in its text (zeros at the ends), whether
    there are such lines, and a constant."""
    ends = np.cumsum(counts)
    first = np.zeros(len(stats), bool)
    first[ends - counts] = True
    last = np.zeros(len(stats), bool)
    last[ends - 1] = True
    before = np.where(first[:, None], 0, np.roll(stats, 1, 0))
    after = np.where(last[:, None], 0, np.roll(stats, -1, 0))
    return np.column_stack([stats, before, after, first, last, np.ones(len(stats))])


def marginals(emission: np.ndarray, step: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over sequences that lie end to end: (P(good) of each line, expected counts of the
    four transitions, log of each sequence's normaliser). emission: score of good against bad; step: 2 x 2."""
    n, order = len(counts), np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    most = int(sizes[0]) if n else 0
    alive = np.searchsorted(-sizes, -np.arange(1, most + 1), side="right")
    e = np.stack([np.zeros(len(emission)), emission], 1)
    e -= e.max(1, keepdims=True)
    shift = np.maximum(emission, 0)
    p, t = np.exp(e), np.exp(step)
    forward, scale = np.zeros((len(emission), 2)), np.zeros(len(emission))
    a = None
    for k in range(most):
        at = begin[: alive[k]] + k
        a = p[at] if k == 0 else a[: alive[k]] @ t * p[at]
        s = a.sum(1)
        a = a / s[:, None]
        forward[at], scale[at] = a, s
    backward = np.ones((len(emission), 2))
    for k in range(most - 2, -1, -1):
        at = begin[: alive[k + 1]] + k
        backward[at] = (p[at + 1] * backward[at + 1]) @ t.T / scale[at + 1][:, None]
    good = (forward * backward)[:, 1]
    follows = np.ones(len(emission), bool)
    follows[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(follows)
    pair = forward[at - 1][:, :, None] * t[None] * (p[at] * backward[at])[:, None, :] / scale[at][:, None, None]
    owner = np.repeat(np.arange(n), counts)
    z = np.bincount(owner, weights=np.log(scale) + shift, minlength=n)
    return good, pair.sum(0), z


class Model:
    """Weights of the lines' statistics and of the steps between labels."""

    def __init__(self, weights: np.ndarray, step: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> None:
        self.weights, self.step, self.mean, self.spread = weights, step, mean, spread

    def emission(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread @ self.weights

    def score(self, texts: list[str]) -> np.ndarray:
        """Per text the mean of its lines' P(good), weighted by length; an empty line weighs one character."""
        stats, size, counts = line_statistics(texts)
        good, _, _ = marginals(self.emission(with_neighbours(stats, counts)), self.step, counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        weight = np.maximum(size, 1)
        return np.clip(np.bincount(owner, good * weight) / np.bincount(owner, weight), 0, 1)


def fit_sequences(stats: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
    """Maximise the conditional likelihood of lines that inherit their text's label (1 good)."""
    x = with_neighbours(stats, counts)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    x = (x - mean) / spread
    cut = np.concatenate([np.full(-(-c // TRAIN_LINES), TRAIN_LINES) for c in counts])
    cut[np.cumsum(-(-counts // TRAIN_LINES)) - 1] = (counts - 1) % TRAIN_LINES + 1
    y = np.repeat(labels, counts).astype(float)
    follows = np.ones(len(y), bool)
    follows[np.cumsum(cut) - cut] = False
    at = np.flatnonzero(follows)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, STEPS + 1):
        good, pairs, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), cut)
        slope = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(y) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta += RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2), mean, spread)


def stretches(lines: np.ndarray) -> np.ndarray:
    """At most MOST_LINES of the lines: stretches of TRAIN_LINES at even distances."""
    if len(lines) <= MOST_LINES:
        return lines
    starts = np.linspace(0, len(lines) - TRAIN_LINES, MOST_LINES // TRAIN_LINES).astype(int)
    return np.concatenate([lines[a : a + TRAIN_LINES] for a in starts])


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all ids that training never sees; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model | None:
    """The model of at most `most` labelled documents outside the held-out fifth; None without both labels.

    Of a doc_id with several labels the lower one counts, and of several rows of a document one. A document with
    more than MOST_LINES lines gives that many, stretches of TRAIN_LINES spread over the whole text; so the driver gets
    most * MOST_LINES rows of FEATURES numbers at most.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")  # `most` rows

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in common.small_batches(batches):
            stats, _, counts = line_statistics(["" if t is None else t for t in pdf["text"]])
            cut = [stretches(c) for c in np.split(stats.astype(np.float32), np.cumsum(counts)[:-1])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "good": (pdf["quality"] > 0).astype(int), "stats": [c.tobytes() for c in cut]})

    found = rows.mapInPandas(describe, "doc_id long, good int, stats binary")
    found = found.groupBy("doc_id").agg(F.min("stats").alias("stats"), F.min("good").alias("good")).toPandas()
    found = found.sort_values("doc_id")
    if found["good"].nunique() < 2:
        return None
    each = [np.frombuffer(s, np.float32).reshape(-1, FEATURES) for s in found["stats"]]
    return fit_sequences(np.concatenate(each).astype(float), np.array([len(e) for e in each]), found["good"].to_numpy())


def scored(docs: DataFrame, model: Model | None, column: str = "quality_score") -> DataFrame:
    """`docs` with a score in `column`, replacing a column of that name. Null text counts as empty: one empty
    line. Without a model all score 1.0. Repeated rows score alike. Empty table: empty result."""
    if model is None:
        return docs.drop(column).withColumn(column, F.lit(1.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batch) -> dict[str, list]:
        return {column: sent.value.score(["" if t is None else t for t in batch.column("text").to_pylist()])}

    return common.map_rows(docs, run, {column: "double"})


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Only the text goes into a score."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    out = scored(narrow, train(narrow, labels))
    score = F.col("quality_score")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, with their columns as they were."""
    out = scored(docs, train(docs, labels), "__score")
    return out.where(F.col("__score") >= threshold).select(*[f"`{c}`" for c in docs.columns])
