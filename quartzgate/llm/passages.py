"""Substring dedup by MinHash banding of paragraphs.

A passage that repeats may begin anywhere in a line, so paragraphs are cut by content: one starts at
each word whose hash (over SEED_WORDS words) is the least of some window of consecutive ones. There
are two sizes. Short ones, of LENGTH words, meet word for word: any run of WINDOW + LENGTH - 1 = 50
words that two texts share holds one that starts at the same place of the run in both. Long ones, of
LONG words, and natural paragraphs of LENGTH words or more (each line, and in texts with blank lines
each block between them) meet by MinHash bands over five-word shingles, so that copies which are
edited here and there are found, inside a line as well. Of a long one the words beyond MARGIN count as
repeated, so that words beside a passage stay.

Keys meet as packed postings. Candidates by bands are verified by exact Jaccard similarity, equal
paragraphs being one node, and clusters are the connected components. In each cluster that spans
several documents the one with the smallest doc_id keeps its passage.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ngram_join, postings, shingles

LENGTH, WINDOW, SEED_WORDS = 36, 15, 3
LONG, LONG_WINDOW = 100, 64
#: Eight bands of three rows: a pair at similarity 0.8 meets with 1 - (1 - 0.8^3)^8 = 0.997, one at 0.2 with 0.06.
BANDS, ROWS = 8, 3
WORDS, NUM, DEN = 5, 80, 100
#: Shingles of a long paragraph, and of the stretches that its least hashes are put together from.
_WIDTH, _STRETCH = LONG - WORDS + 1, 32
#: Words at either end of a long paragraph that a verified partner may lack: they don't count as repeated.
MARGIN = _WIDTH - -(-2 * _WIDTH * NUM // (NUM + DEN))
#: An odd number and its inverse: hashes of word sequences are polynomials in it.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of `width` entries."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Paragraphs:
    """All paragraphs of a batch of texts: owner (index of the text), word (index in it), at (index among all words),
    size (words) and group. Groups come one after another, each in the order of the texts: SHORT, LONGS, LINES, BLOCKS."""

    SHORT, LONGS, LINES, BLOCKS = range(4)

    def __init__(self, texts: list[str | None]) -> None:
        self.hash, self.begins, self.ends, counts = shingles.words(texts)
        n = len(self.hash)
        upto = np.cumsum(counts)
        self.run = shingles.rolling(self.hash, WORDS)
        found = [np.zeros((0, 2), np.int64)] * 4
        if n >= LENGTH:
            seed = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
            own = shingles.rolling(self.hash, SEED_WORDS)
            seed[: len(own)] = np.maximum(own, np.uint64(1))
            for group, length, window in ((self.SHORT, LENGTH, WINDOW), (self.LONGS, LONG, LONG_WINDOW)):
                start = self._starts(seed, counts, upto, length, window)
                found[group] = np.stack([start, np.full(len(start), length)], 1)
            found[self.LINES :] = self._natural(texts, upto)
        self.group = np.repeat(np.arange(4), [len(f) for f in found])
        self.at, self.size = np.concatenate(found).T.copy()
        self.owner = np.searchsorted(upto, self.at, "right")
        self.word = self.at - (upto - counts)[self.owner]

    @staticmethod
    def _starts(g: np.ndarray, counts: np.ndarray, upto: np.ndarray, length: int, window: int) -> np.ndarray:
        """Words at which paragraphs of `length` words start."""
        n = len(g)
        # from each word, how many places for a paragraph remain in its text, itself included
        room = np.repeat(upto - length + 1, counts) - np.arange(n)
        chosen = np.zeros(n, bool)
        if n >= window:
            least = np.zeros(n + window - 1, np.uint64)
            inside = _sliding(g, window, np.minimum)
            inside[room[: len(inside)] < window] = 0
            least[window - 1 : window - 1 + len(inside)] = inside
            chosen = (_sliding(least, window, np.maximum)[:n] == g) & (room > 0)
        # in a run of adjacent places of one hash, as a repeated word gives, its first place and every window-th
        # from its last are enough: a shared run that isn't all of that word holds the same end of it in both texts
        last = np.flatnonzero(np.concatenate([g[1:] != g[:-1], [True]]))
        size = np.diff(last, prepend=-1)
        enough = (np.repeat(last, size) - np.arange(n)) % window == 0
        enough[last - size + 1] = True
        chosen &= enough
        for i in np.flatnonzero((counts >= length) & (counts < length + window - 1)):
            start = upto[i] - counts[i]
            chosen[start + np.argmin(g[start : start + counts[i] - length + 1])] = True
        return np.flatnonzero(chosen)

    def _natural(self, texts: list[str | None], upto: np.ndarray) -> list[np.ndarray]:
        """(first word, words) of each line, and of each block between blank lines that isn't one line or a whole text."""
        raw = np.frombuffer(b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts), np.uint8)
        line = np.searchsorted(np.flatnonzero(raw == 10), self.begins)
        n = len(self.begins)
        fresh = np.zeros(n + 1, bool)  # where texts start
        fresh[np.concatenate([[0], upto])] = True
        step = np.diff(line, prepend=line[0])
        found = []
        for least in (1, 2):  # lines, blocks
            start = np.flatnonzero(fresh[:n] | (step >= least))
            found.append(np.stack([start, np.diff(start, append=n)], 1))
        lines, blocks = found
        text = np.searchsorted(upto, blocks[:, 0], "right")
        blocks = blocks[np.bincount(text, minlength=len(upto))[text] > 1]
        own = lines[np.searchsorted(lines[:, 0], blocks[:, 0])]  # the line that a block starts with
        blocks = blocks[own[:, 1] != blocks[:, 1]]
        return [x[x[:, 1] >= LENGTH] for x in (lines, blocks)]

    @property
    def banded(self) -> np.ndarray:
        return self.group != self.SHORT

    def band_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, index of the paragraph that each belongs to) of all but the short ones."""
        rows = np.flatnonzero(self.banded)
        if not len(rows):
            return np.zeros(0, np.uint64), rows
        long_at = self.at[self.group == self.LONGS]
        natural = [np.flatnonzero(self.group == g) for g in (self.LINES, self.BLOCKS)]
        edges = [np.stack([self.at[x], self.at[x] + self.size[x] - WORDS + 1], 1).ravel() for x in natural]
        steps = sorted({*range(0, _WIDTH - _STRETCH, _STRETCH), _WIDTH - _STRETCH})
        least = np.zeros((BANDS * ROWS, len(rows)), np.uint32)
        half = np.zeros(len(self.run) + 1, np.uint32)
        for j in range(BANDS * ROWS):
            if j % 2 == 0:  # the two halves of a hash order shingles independently
                h = shingles.mix(self.run, 11 + j // 2)
            half[:-1] = h if j % 2 else h >> np.uint64(32)
            parts = []
            if len(long_at):
                near = _sliding(half[:-1], _STRETCH, np.minimum)
                parts.append(np.minimum.reduce([near[long_at + k] for k in steps]))
            parts += [np.minimum.reduceat(half, e)[::2] for e in edges if len(e)]
            least[j] = np.concatenate(parts)
        keys = []
        for band in range(BANDS):
            key = np.full(len(rows), np.uint64(band + 1))
            for m in least[band * ROWS : (band + 1) * ROWS]:
                key = shingles.mix(key * np.uint64(_BASE) + m.astype(np.uint64))
            keys.append(key)
        return np.concatenate(keys), np.tile(rows, BANDS)

    def nodes(self) -> np.ndarray:
        """A hash of each paragraph's words and their number."""
        n = len(self.run)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.run * _powers(_BASE, n), out=sums[1:])
        whole = (sums[self.at + self.size - WORDS + 1] - sums[self.at]) * _powers(_INVERSE, n)[self.at] if len(self.at) else sums[:0]
        return shingles.mix(whole + shingles.mix(self.size.astype(np.uint64), 71)).view(np.int64)

    def set_of(self, i: int) -> np.ndarray:
        """The shingles of a paragraph, sorted, by the upper halves of their hashes."""
        a = self.at[i]
        return np.unique((self.run[a : a + self.size[i] - WORDS + 1] >> np.uint64(32)).astype(np.uint32))


#: Kinds of packed rows: short paragraphs, bands of others, and where those others stand.
_SHORT, _BAND, _PLACE = 1, 2, 3
_PLACED = [np.int64, np.int64, np.int32, np.int32, np.uint8]
_FOUND = "node long, doc_id long, word int, words int, natural boolean, keep long, key long, times long, whole boolean, nodes array<long>"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(c, None) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def met(held: DataFrame) -> DataFrame:
    """What the paragraphs of held (doc_id, text) have in common, as rows of three kinds. Short paragraphs in several
    documents: node, doc_id, word, words, and keep where all of the node's came together. Others, all of them:
    node, doc_id, word, words, natural. Bands that several of these, and several
    documents, share: key, times, whole, nodes."""
    each = 2 / (WINDOW + 1) + BANDS * (2 / (LONG_WINDOW + 1) + 1 / LENGTH)
    count = postings.segments(held.sparkSession, postings.words(held) * each)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, band = postings.Sender(_SHORT, count), postings.Sender(_BAND, count)
        for at, part in enumerate(common.text_slices(batches)):
            p = Paragraphs(part.column("text").to_pylist())
            nodes, doc_ids = p.nodes(), part.column("doc_id").to_numpy()[p.owner]
            word, size = p.word.astype(np.int32), p.size.astype(np.int32)
            some, other = ~p.banded, p.banded
            yield from short.add(nodes[some].view(np.uint64), doc_ids[some], word[some])
            keys, row = p.band_keys()
            yield from band.add(keys, doc_ids[row], nodes[row])
            if other.any():
                natural = (p.group[other] >= p.LINES).astype(np.uint8)
                cut = np.where(natural, 0, MARGIN).astype(np.int32)
                yield postings.row(_PLACE, at % count, int(other.sum()), postings.packed(nodes[other], doc_ids[other], word[other] + cut, size[other] - 2 * cut, natural))
        yield from short.flush()
        yield from band.flush()

    def whole(found: postings.Shared) -> pa.RecordBatch:
        fresh = ~found.old
        node, doc_id, word = (c[fresh] for c in found.columns)
        keep, known = (np.repeat(x, found.sizes)[fresh] for x in (found.columns[1][found.first], found.whole))
        words = pa.array(np.full(len(node), LENGTH, np.int32))
        return _rows(node=pa.array(node.view(np.int64)), doc_id=pa.array(doc_id), word=pa.array(word), words=words, keep=pa.array(keep, mask=~known))

    def parts(found: postings.Shared) -> Iterator[pa.RecordBatch]:
        nodes = found.distinct(2)
        if nodes is not None:
            yield from ngram_join.shared_parts(nodes, _TYPES[:6], _NAMES)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = postings.Receiver([np.uint64, np.int64, np.int32], once=False)
        band = postings.Receiver([np.uint64, np.int64, np.int64], once=False)
        for batch in batches:
            for kind, n, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "n", "packed"))):
                if kind == _SHORT:
                    yield from map(whole, short.add(n, raw))
                elif kind == _BAND:
                    for found in band.add(n, raw):
                        yield from parts(found)
                else:
                    node, doc_id, word, words, natural = postings.unpacked(raw, n, _PLACED)
                    yield _rows(node=pa.array(node), doc_id=pa.array(doc_id), word=pa.array(word), words=pa.array(words), natural=pa.array(natural.astype(bool)))
        yield from map(whole, short.finish())
        for found in band.finish():
            yield from parts(found)
        common.trim()

    sent = held.mapInArrow(send, postings.SCHEMA)
    return postings.dealt(sent, count).mapInArrow(meet, _FOUND)


def _sets_of(held: DataFrame, holders: DataFrame) -> DataFrame:
    """Rows (node, n, bits, s) of the paragraphs in holders (node, doc_id)."""
    low_bits = F.pmod(F.col("node").bitwiseXOR(F.col("doc_id")), F.lit(ngram_join.NEEDED_BITS))
    needed = held.sparkSession.sparkContext.broadcast(ngram_join.filter_of(holders.select(low_bits.alias("at"))))

    def describe(slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(zlib.decompress(needed.value), np.uint8)
        for part in slices:
            p = Paragraphs(part.column("text").to_pylist())
            nodes = p.nodes()
            doc_ids = part.column("doc_id").to_numpy()[p.owner]
            some = np.flatnonzero(p.banded & ngram_join.passes(filled, (nodes ^ doc_ids) & (ngram_join.NEEDED_BITS - 1)))
            nodes, first = np.unique(nodes[some], return_index=True)
            sets = [p.set_of(i) for i in some[first].tolist()]
            made = {
                "node": pa.array(nodes), "n": pa.array([len(s) for s in sets], pa.int64()),
                "bits": pa.array([ngram_join.bitmap(s) for s in sets], pa.binary()), "s": pa.array([s.tobytes() for s in sets], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(made)

    found = ngram_join.among(held, holders.select("doc_id").distinct(), describe, "node long, n long, bits binary, s binary")
    return found.join(holders.select("node"), "node", "left_semi").dropDuplicates(["node"])


def occurrences(docs: DataFrame) -> DataFrame:
    """Rows (cluster, doc_id, word, words, keep): paragraphs that repeat across documents, `words` long. keep is the
    smallest doc_id of the cluster. Rows with a null doc_id take no part; repeated rows of a doc_id are one document."""
    held = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    seen = common.materialize(met(held), "passages")
    place = ["node", "doc_id", "word", "words"]
    short = seen.where("natural is null and node is not null")
    others = seen.where("natural is not null").select(*place, "natural")
    members = ngram_join.members_of(seen.where("key is not null").select("key", "times", "whole", "nodes"))
    members = common.materialize(members, "passage-members")
    holders = others.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(members.select("node"), "node", "left_semi")
    holders = common.materialize(holders, "passage-holders")
    arrays = common.materialize(_sets_of(held, holders), "passage-arrays")
    linked = ngram_join.linked_components(members, arrays, lambda nodes: arrays, NUM, DEN, np.uint32)
    common.release(members, holders, arrays)

    # the long ones that repeat word for word hold short ones that do; a short one that came in several parts is
    # named anew
    parts = short.where("keep is null").groupBy("node").agg(F.min("doc_id").alias("_keep"))
    late = short.where("keep is null").select(*place).join(parts, "node").withColumnRenamed("_keep", "keep")
    each = others.join(linked, "node", "left").where("natural or component is not null")
    each = each.select(F.coalesce("component", "node").alias("cluster"), "doc_id", "word", "words")
    keep = each.groupBy("cluster").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("_last"))
    each = each.join(keep.where("keep < _last").select("cluster", "keep"), "cluster")
    verbatim = short.where("keep is not null").select(*place, "keep").unionByName(late).withColumnRenamed("node", "cluster")
    return verbatim.unionByName(each).select("cluster", "doc_id", "word", "words", "keep")


def merged_spans(found: DataFrame) -> DataFrame:
    """Rows (doc_id, first_word, n_words, keep, removed, n_clusters): overlapping or touching paragraphs of a document as one
    passage, those that go (another document keeps them) and those that stay apart. keep is the smallest doc_id that
    keeps one of its paragraphs."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "removed").orderBy("word", "words")
    end = F.col("word") + F.col("words")
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = found.withColumn("removed", F.col("keep") < F.col("doc_id")).withColumn("_new", F.when(F.col("word") <= before, 0).otherwise(1))
    run = cut.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "removed", "_run").agg(
        F.min("word").alias("first_word"), (F.max(end) - F.min("word")).cast("int").alias("n_words"),
        F.min("keep").alias("keep"), F.countDistinct("cluster").alias("n_clusters"),
    ).drop("_run")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, first_word, n_words, keep, removed): the passages of each document that repeat across documents. Those with
    `removed` are exactly what dedup_passages cuts; the others are kept here for other documents (words of them that a
    removed one covers go with that one).

    Documents without a passage have no row, nor have rows with a null doc_id and null, empty or short texts; repeated
    rows of a doc_id are one document. Other columns aren't read. Empty table: empty result.
    """
    return merged_spans(occurrences(docs)).select("doc_id", "first_word", "n_words", "keep", "removed")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words from..to (exclusive) of each span, and without the blanks after them."""
    _, begins, ends, _ = shingles.words([text])
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for first, last in sorted(spans):
        out.append(raw[at : begins[first]])
        at = int(begins[last]) if last < len(begins) else len(raw)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def dedup_passages(docs: DataFrame) -> DataFrame:
    """`docs` with the text that stays when each repeated passage stays in one document only.

    Texts are cut into words at white space; a removed passage goes with the blanks after it. Null and
    empty texts stay as they are; rows with a null doc_id stay whole; repeated rows of a doc_id lose
    the same passages; n_chars, where there, follows the new text. Empty table: empty result.
    """
    spans = merged_spans(occurrences(docs).where("keep < doc_id"))
    gone = spans.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("__gone"))
    new = {"text": "string"}
    if "n_chars" in docs.columns:
        new["n_chars"] = docs.schema["n_chars"].dataType

    def run(batch) -> dict[str, list]:
        texts = batch.column("text").to_pylist()
        out = list(texts)
        for i, words in enumerate(batch.column("__gone").to_pylist()):
            if words and texts[i]:
                out[i] = without_spans(texts[i], [(x["first_word"], x["first_word"] + x["n_words"]) for x in words])
        if "n_chars" not in new:
            return {"text": out}
        chars = batch.column("n_chars").to_pylist()
        return {"text": out, "n_chars": [n if a == b else len(b) for n, a, b in zip(chars, texts, out)]}

    return common.map_rows(common.with_lists(docs, gone), run, new, gone=("__id", "__gone"))
