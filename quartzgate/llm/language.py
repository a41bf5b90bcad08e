"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes with the counts of what follows. A byte's code length is
found from the longest context that the tree has: where the byte followed it before, its share of n in T + D (T bytes seen,
D different ones), else an escape of D in T + D and the next shorter context, from which all bytes that the longer one
offered are excluded; below the empty context all other byte values are equally likely. These are the lengths that an
arithmetic coder with the frozen counts would write, and the language that needs the fewest bits wins.

Counts are gathered by Spark on a sample bounded in bytes, so trees are small enough to broadcast. The code lengths of the
most frequent byte sequences, resolved once for all languages, sit in a hash table; others are resolved where they occur,
with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, shingles

#: Bytes of the longest context; with the byte that follows it fits a 64-bit number.
ORDER = 4
#: Training takes about so many bytes of whole texts, shared evenly by at most so many languages, those with most bytes.
TRAIN_BYTES, LANGUAGES = 6_000_000, 256
#: Code lengths in the hash table: so many, whatever the languages. It is a cache and changes no result.
CELLS = 1 << 21
#: Stands before every text ORDER times; no byte of UTF-8.
PAD = 0xFF


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(each byte of all texts below the ORDER bytes before it as one number, bytes of each text)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    pad = bytes([PAD]) * ORDER
    codes = np.frombuffer(b"".join(x for r in raw for x in (pad, r)), np.uint8)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    keys = codes.astype(np.uint64)
    for back in range(1, ORDER + 1):
        keys[back:] |= codes[:-back].astype(np.uint64) << np.uint64(8 * back)
    return keys[codes != PAD], np.array([len(r) for r in raw])


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The index of each key in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Tree:
    """The contexts of one language. Per order: contexts and (context, byte) pairs as sorted numbers, bits of an escape and of
    the total without exclusions, and after an escape from the context one byte longer."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.levels = []
        total = [None] * (ORDER + 1)
        for order in range(ORDER + 1):
            pairs, at = np.unique(keys & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(at, weights=counts)
            contexts, first, kinds = np.unique(pairs >> np.uint64(8), return_index=True, return_counts=True)
            total[order] = (contexts, np.add.reduceat(n, first), kinds)
            level = {"pairs": pairs, "bits": np.log2(n), "contexts": contexts, "total": np.log2(total[order][1] + kinds), "escape": -np.log2(kinds / (total[order][1] + kinds))}
            if order:
                shorter, above, fewer = total[order - 1]
                base = find(shorter, contexts & np.uint64((1 << 8 * (order - 1)) - 1))
                own = find(self.levels[-1]["pairs"], pairs & np.uint64((1 << 8 * order) - 1))
                left = above[base] - np.add.reduceat(2 ** self.levels[-1]["bits"][own], first)
                others = fewer[base] - kinds
                rest = np.rint(left) + others
                # where the shorter context offers nothing new, it is passed without a cost
                level["total_after"] = np.log2(np.maximum(rest, 1))
                level["escape_after"] = np.where(others > 0, np.log2(np.maximum(rest, 1) / np.maximum(others, 1)), 0)
            self.levels.append(level)
        self.unseen = float(np.log2(256 - total[0][2][0])) if len(keys) else 8.0

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each key after its other bytes."""
        out = np.zeros(len(keys))
        live, longer = np.arange(len(keys)), np.full(len(keys), -1)
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            key = keys[live] & np.uint64((1 << 8 * (order + 1)) - 1)
            pair, context = find(level["pairs"], key), find(level["contexts"], key >> np.uint64(8))
            excluded = longer >= 0
            above = self.levels[min(order + 1, ORDER)]
            seen, there = pair >= 0, context >= 0
            total, escape = np.zeros(len(live)), np.zeros(len(live))
            total[there], escape[there] = level["total"][context[there]], level["escape"][context[there]]
            if excluded.any():
                total[excluded], escape[excluded] = above["total_after"][longer[excluded]], above["escape_after"][longer[excluded]]
            out[live] += np.where(seen, total - level["bits"][np.maximum(pair, 0)], escape)
            live, longer = live[~seen], np.where(there, context, -1)[~seen]
        out[live] += self.unseen
        return out


class Model:
    """The trees of all languages, in order of their names, and the table of the most frequent keys."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> None:
        self.names = sorted(counts)
        self.trees = [Tree(*counts[n]) for n in self.names]
        keys, at = np.unique(np.concatenate([counts[n][0] for n in self.names]), return_inverse=True)
        often = np.bincount(at, weights=np.concatenate([counts[n][1] for n in self.names]))
        most = cells // len(self.names)
        if len(keys) > most:
            keys = np.sort(keys[np.argsort(-often, kind="stable")[:most]])
        self.width = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.width, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros((1 << self.width, len(self.names)))
        left, tries = np.arange(len(keys)), 0
        resolved = self.resolve(keys)
        while len(left):
            slot = self._slot(keys[left], tries)
            free = self.slots[slot] == np.iinfo(np.uint64).max
            slot, first = np.unique(slot[free], return_index=True)
            placed = left[free][first]
            self.slots[slot], self.values[slot] = keys[placed], resolved[placed]
            left, tries = np.setdiff1d(left, placed, assume_unique=True), tries + 1
        self.tries = tries

    def _slot(self, keys: np.ndarray, tries: int) -> np.ndarray:
        h = (keys * shingles.GOLDEN) >> np.uint64(64 - self.width)
        return ((h + np.uint64(tries)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def resolve(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(keys) for t in self.trees], 1)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The code length of each key's last byte in each language."""
        at = self._slot(keys, 0)
        left = np.flatnonzero(self.slots[at] != keys)
        missing = []
        for tries in range(1, self.tries + 1):
            if not len(left):
                break
            gone = self.slots[at[left]] == np.iinfo(np.uint64).max
            missing.append(left[gone])
            left = left[~gone]
            at[left] = self._slot(keys[left], tries)
            left = left[self.slots[at[left]] != keys[left]]
        out = self.values[at]
        missing = np.concatenate([*missing, left]) if missing else left
        if len(missing):
            rare, back = np.unique(keys[missing], return_inverse=True)
            out[missing] = self.resolve(rare)[back]
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The code length in bits of each text in each language."""
        keys, counts = grams(texts)
        out = np.zeros((len(texts), len(self.names)))
        ends, some = np.cumsum(counts), np.flatnonzero(counts)
        if len(some):
            out[some] = np.add.reduceat(self.bits(keys), (ends - counts)[some], axis=0)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, its share of the likelihood of all) of each text; ties go to the first name."""
        bits = self.lengths(texts)
        best = bits.argmin(1)
        more = bits - bits[np.arange(len(bits)), best][:, None]
        return [self.names[b] for b in best], 1 / (2.0 ** -np.minimum(more, 1000)).sum(1)


def count_grams(texts: DataFrame) -> DataFrame:
    """Rows (lang, key, n) of texts (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.text_slices(batches):
            langs = part.column("lang").dictionary_encode()
            keys, counts = grams([t or "" for t in part.column("text").to_pylist()])
            owner = np.repeat(langs.indices.to_numpy(), counts)
            for i, name in enumerate(langs.dictionary.to_pylist()):
                found, n = np.unique(keys[owner == i], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(found), pa.string()), "key": pa.array(found.view(np.int64)), "n": pa.array(n)})

    found = texts.select("lang", "text").mapInArrow(run, "lang string, key long, n long")
    return found.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Column, most: int = TRAIN_BYTES, cells: int = CELLS) -> Model | None:
    """The model of the rows of `docs` for which `learn` holds and lang and text aren't null; None without any.

    Of each language the shortest text is taken, and whole others by a hash of their ids, about most / languages bytes in
    all and none longer than that by itself. So the driver and the broadcast get at most about one row for each of `most`
    bytes, and LANGUAGES languages, those with most bytes. The same rows give the same model.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    size = F.octet_length("text").cast("long")
    totals = known.groupBy("lang").agg(F.sum(size).alias("_bytes"), F.min(F.struct(size, F.col("doc_id").cast("long"))).alias("_least")).orderBy(F.desc("_bytes"), "lang").limit(LANGUAGES)
    totals = [tuple(r) for r in totals.collect()]  # LANGUAGES rows
    if not totals:
        return None
    room = most // len(totals)
    shares = docs.sparkSession.createDataFrame([(n, min(1.0, room / b), least[1]) for n, b, least in totals], "lang string, _share double, _first long")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < F.col("_share") * (1 << 30)
    sample = known.join(F.broadcast(shares), "lang").where((drawn & (size <= room)) | F.col("doc_id").eqNullSafe(F.col("_first")))
    rows = count_grams(sample).toPandas()
    if not len(rows):
        return None
    return Model({name: (g["key"].to_numpy().view(np.uint64), g["n"].to_numpy()) for name, g in rows.groupby("lang")}, cells)


def identify(docs: DataFrame, model: Model | None, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with the language of each text and its share of the likelihood of all languages, 0 to 1. Columns of those names
    are replaced, no other one but text is read.

    Texts that are null or have no letter are `und` with score 0, and so are all without a model. Repeated rows and rows
    with a null doc_id are judged like others. Empty table: empty result.
    """
    if model is None:
        return docs.drop(language, score).withColumns({language: F.lit("und"), score: F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAIN_BYTES and CELLS

    def run(batch) -> dict[str, list]:
        texts = batch.column("text").to_pylist()
        some = [i for i, t in enumerate(texts) if t and next(filter(str.isalpha, t), None)]
        names, shares = ["und"] * len(texts), [0.0] * len(texts)
        for i, name, share in zip(some, *sent.value.predict([texts[i] for i in some])):
            names[i], shares[i] = name, float(share)
        return {language: names, score: shares}

    return common.map_rows(docs, run, {language: "string", score: "double"})


def remainder(doc_id: Column) -> Column:
    """CRC-32 of the decimal id, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def classify(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Rows whose remainder is 1 are held out, and never learnt from; neither are
    rows with a null id, which aren't held out."""
    rest = remainder(F.col("doc_id"))
    model = train(docs.select(F.col("doc_id").cast("long"), "text", "lang"), F.coalesce(rest != 1, F.lit(False)))
    out = identify(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
