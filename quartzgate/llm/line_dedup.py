"""Line dedup: two Bloom filters find the lines that may repeat, and only those shuffle.

Pass 1 hashes every line key into the positions of a Bloom filter, once for each partition, and
sends the positions to the task that owns their segment. That task keeps two bit arrays, "seen once"
and "seen twice"; what was seen twice is the filter of suspects. Pass 2 shuffles only suspected keys,
counts their documents exactly and picks the document that keeps the line. Pass 3 drops the lines.
False positives of the filter cost a shuffled row each and never change the result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points that a key needs to count.
MIN_CHARS = 20
#: Documents from which on a key is a repeat.
MIN_DOCS = 3
#: Bits of a filter for each line, and the least and most bits of a filter: 128 MB at most.
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 32, 1 << 18, 1 << 30
#: Segments of a filter at most; one task merges whole ones. Positions that a task holds before it sends them.
SEGMENTS, MOST_HELD = 1024, 1_000_000
#: Rows of the removal table that are broadcast at most (16 bytes of key and 8 of id each: 48 MB);
#: a larger table is joined.
BROADCAST_ROWS = 2_000_000


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text as UTF-8, and the key of each; None where the key is too short to count."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(common.BLANKS).lower()
        n = len(key)
        if n < MIN_CHARS or (n < 4 * MIN_CHARS and len(key.decode("utf-8", "surrogatepass")) < MIN_CHARS):
            keys.append(None)
        else:
            keys.append(key)
    return lines, keys


def _positions(keys, bits: int) -> np.ndarray:
    """Two filter positions for each key, as an (n, 2) array."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)], 1)


def _line_positions(texts, bits: int) -> np.ndarray:
    return _positions([k for t in texts for k in line_keys(t)[1] if k is not None], bits)


def suspects_filter(docs: DataFrame, bits: int, positions=_line_positions) -> bytes:
    """The "seen twice" filter over the keys of all texts, `bits` bits packed into bytes; positions(texts,
    bits) gives the filter positions of a batch's keys, by default of all lines' counted keys.

    A key that occurs twice anywhere has all its bits set. Each partition sends a position
    once, or twice where it saw it twice; the merging tasks hold two bit arrays of their segments.
    """

    segments = min(SEGMENTS, max(1, bits >> 16))
    width = bits // segments

    def packed(at: np.ndarray) -> bytes:
        """Positions of a segment: their lower halves, then their upper halves, which compress to little."""
        return (at & 0xFFFF).astype("<u2").tobytes() + (at >> 16).astype("<u2").tobytes()

    def unpacked(raw: bytes) -> np.ndarray:
        low, high = np.split(np.frombuffer(raw, "<u2").astype(np.int64), 2)
        return low + (high << 16)

    def sent(held: list[np.ndarray]) -> pd.DataFrame:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        found = found.astype(np.int64)
        segment = found // width
        cuts = np.flatnonzero(np.diff(segment)) + 1
        inside, twice = np.split(found % width, cuts), np.split(counts > 1, cuts)
        return pd.DataFrame(
            {
                "segment": segment[np.concatenate([[0], cuts])],
                "seen": [packed(x) for x in inside],
                "again": [packed(a[b]) for a, b in zip(inside, twice)],
            }
        )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in common.text_slices(batches):
            held.append(positions(part.column("text").to_pylist(), bits).ravel())
            if sum(map(len, held)) > MOST_HELD:
                yield pa.RecordBatch.from_pandas(sent(held), preserve_index=False)
                held = []
        if sum(map(len, held)):
            yield pa.RecordBatch.from_pandas(sent(held), preserve_index=False)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for segment, seen, again in pdf.itertuples(index=False):
                if segment not in state:
                    state[segment] = (np.zeros(width, bool), np.zeros(width, bool))
                once, twice = state[segment]
                at = unpacked(seen)
                twice[at[once[at]]] = True
                once[at] = True
                twice[unpacked(again)] = True
        rows = [(s, zlib.compress(np.packbits(twice).tobytes(), 1)) for s, (_, twice) in state.items() if twice.any()]
        yield pd.DataFrame(rows, columns=["segment", "twice"])

    spark = docs.sparkSession
    dealt = docs.select("text").mapInArrow(local, "segment long, seen binary, again binary")
    merged = dealt.repartition(min(common.parts(spark), segments), "segment").mapInPandas(merge, "segment long, twice binary")
    out = bytearray(bits // 8)
    step = width // 8
    for row in merged.collect():  # bits / 8 bytes in all, at most MOST_BITS / 8
        out[row["segment"] * step : (row["segment"] + 1) * step] = zlib.decompress(row["twice"])
    return bytes(out)


def filter_bits(docs: DataFrame) -> int:
    """Bits of a filter for these documents: a power of two that grows with the lines, up to MOST_BITS."""
    text = F.coalesce("text", F.lit(""))
    n = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    return min(MOST_BITS, max(LEAST_BITS, 1 << int(np.ceil(np.log2(n * BITS_PER_LINE)))))


def removals(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(suspects, removal): suspects (key, doc_id), and removal (key, keep): keys of at least `min_docs`
    documents with the largest doc_id that holds them. Keys are 128-bit digests of the line key.
    Rows without a doc_id are no documents here. A document that holds a key twice counts once, and
    so do repeated rows of one doc_id.
    """
    bits = filter_bits(docs)
    spark = docs.sparkSession
    twice = spark.sparkContext.broadcast(suspects_filter(docs, bits))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(twice.value, np.uint8)
        for part in common.text_slices(batches):
            out_keys, out_ids = [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                keys = list({k for k in line_keys(text)[1] if k is not None})
                if keys:
                    at = _positions(keys, bits).astype(np.int64)
                    hit = ((filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
                    out_keys += [xxhash.xxh3_128_digest(keys[i]) for i in np.flatnonzero(hit)]
                    out_ids += [doc_id] * int(hit.sum())
            yield pa.RecordBatch.from_pydict({"key": pa.array(out_keys, pa.binary()), "doc_id": pa.array(out_ids, pa.int64())})

    held = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    suspects = common.materialize(held.mapInArrow(pick, "key binary, doc_id long"), "suspects")
    each = suspects.distinct()
    removal = each.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep"))
    return suspects, common.materialize(removal.where(F.col("n_docs") >= min_docs), "removal")


def _rewritten(texts: list[str | None], chars: list[int] | None, dropped_in) -> dict[str, list]:
    """The columns of a batch: the text that stays, n_chars where there, and what became of the lines."""
    out: dict[str, list] = {"text": [], "n_lines": [], "n_dropped": [], "kept_sha256": []}
    if chars is not None:
        out["n_chars"] = []
    for i, text in enumerate(texts):
        lines, keys = line_keys(text)
        gone = dropped_in(i, keys)
        kept = [x for x, k in zip(lines, keys) if k is None or k not in gone] if gone else lines
        joined = b"\n".join(kept)
        n = len(lines) - len(kept)
        new = joined.decode("utf-8", "surrogatepass") if n else text
        out["text"].append(new)
        out["n_lines"].append(len(lines))
        out["n_dropped"].append(n)
        out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
        if chars is not None:
            out["n_chars"].append(len(new) if n else chars[i])
    return out


def _sorted_keys(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first halves of the keys, ascending, second halves, keep) of an Arrow table (key, keep)."""
    halves = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint64).reshape(-1, 2)
    order = np.argsort(halves[:, 0])
    return halves[order, 0], halves[order, 1], rows.column("keep").to_numpy()[order]


def _looked_up(table: tuple[np.ndarray, np.ndarray, np.ndarray], keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keep, whether there) for each key."""
    first, second, keep = table
    halves = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    at = np.searchsorted(first, halves[:, 0])
    out, known = np.zeros(len(halves), np.int64), np.zeros(len(halves), bool)
    todo = np.arange(len(halves))
    while len(todo):
        todo = todo[at[todo] < len(first)]
        todo = todo[first[at[todo]] == halves[todo, 0]]
        hit = todo[second[at[todo]] == halves[todo, 1]]
        out[hit], known[hit] = keep[at[hit]], True
        todo = todo[~known[todo]]
        at[todo] += 1
    return out, known


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All columns of `docs` with the text that stays, and n_lines, n_dropped, kept_sha256.

    Lines are cut at \\n. A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of at least MIN_CHARS code points in at least `min_docs` documents lose all their lines
    except in the largest doc_id that holds them.

    Null or empty text: one empty line. Null doc_id: the row keeps all its lines and counts for no
    key. Repeated rows of a doc_id are one document and keep alike. Empty table: empty result.
    Columns of `docs` named like a new one are replaced. n_chars, where there, follows the new text.
    """
    suspects, removal = removals(docs, min_docs)
    spark = docs.sparkSession
    new = {"text": "string", "n_lines": "long", "n_dropped": "long", "kept_sha256": "string"}
    if "n_chars" in docs.columns:
        new["n_chars"] = docs.schema["n_chars"].dataType
    chars = lambda batch: batch.column("n_chars").to_pylist() if "n_chars" in new else None

    if removal.count() <= broadcast_rows:
        table = spark.sparkContext.broadcast(_sorted_keys(removal.select("key", "keep").toArrow()))
        common.release(suspects, removal)

        def by_table(batch) -> dict[str, list]:
            ids = batch.column("doc_id").to_pylist()

            def gone(i: int, keys) -> set:
                named = [] if ids[i] is None else list({k for k in keys if k is not None})
                keep, known = _looked_up(table.value, [xxhash.xxh3_128_digest(k) for k in named])
                return {k for k, v, x in zip(named, keep.tolist(), known.tolist()) if x and v != ids[i]}

            return _rewritten(batch.column("text").to_pylist(), chars(batch), gone)

        return common.map_rows(docs, by_table, new)

    drops = (
        suspects.join(removal.select("key", "keep"), "key")
        .where("doc_id <> keep")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.collect_set("key").alias("__gone"))
    )

    def by_join(batch) -> dict[str, list]:
        lists = batch.column("__gone").to_pylist()

        def gone(i: int, keys) -> set:
            if lists[i] is None:
                return set()
            named = set(lists[i])
            return {k for k in keys if k is not None and xxhash.xxh3_128_digest(k) in named}

        return _rewritten(batch.column("text").to_pylist(), chars(batch), gone)

    return common.map_rows(common.with_lists(docs, drops), by_join, new, gone=("__id", "__gone"))
