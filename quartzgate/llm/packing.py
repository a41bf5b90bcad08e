"""Best-fit packing by minimum bin slack.

How full the bins get depends on the piece lengths alone, so the driver needs only their histogram,
one row for each length up to the capacity. Per bin it takes the largest length left and finds, by a
bitset subset-sum programme over the lengths still available, the fullest combination beside it; the
combination is removed, and used again as often as the counts allow. That gives patterns with
multiplicities, a few for each length. Every piece then finds its place from its ordinal among the
pieces of its length, which is counted in groups by a salt of the row; a length has as many groups as its
pieces ask for. Pieces that fill a sequence need no place.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
#: Id that ends every document.
END_ID = 1
#: Pieces of one length that are ranked together on average, and the range of the salts that part them.
IN_GROUP, SALTS = 50_000, 1 << 30
#: Units that a worker remembers before it starts anew.
CACHE = 1_500_000
#: Python counts these as white space, Unicode doesn't; "<|" may start a special token.
WHOLE = re.compile("[\x1c-\x1f]|<\\|")


class Memory:
    """What a worker remembers of the units it has encoded: their hashes, and their ids end to end."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.start = np.zeros(1 << 18, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each unit, -1 where it isn't known. Sorted arrays take a tenth of a dictionary's memory."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.slots[at], -1)

    def add(self, hashes: np.ndarray, units: list[str]) -> None:
        made = [e.ids for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]
        flat = list(itertools.chain.from_iterable(made))
        n, more = len(self.keys), len(made)
        used = int(self.start[n])
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys = np.insert(self.keys, at, hashes[order])
        self.slots = np.insert(self.slots, at, n + order)
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + more + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[used : used + len(flat)] = flat
        self.start[n + 1 : n + more + 1] = used + np.cumsum(np.fromiter(map(len, made), np.int64, more))


@functools.lru_cache(maxsize=2)
def _memory(path: str) -> Memory:
    return Memory(path)


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 65536 its kind (0 blank, 1 letter that changes case and composes by itself,
    2 mark other than the apostrophe, 3 anything else) and what lower case adds to it."""
    kind, add = np.full(65536, 3, np.uint8), np.zeros(65536, np.uint32)
    for c in range(65536):
        if chr(c).isspace():
            kind[c] = 0
    for c in [*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256)]:
        kind[c] = 1
    for c in range(33, 127):
        if not chr(c).isalnum() and c != 39:
            kind[c] = 2
    add[65:91] = add[192:215] = add[216:223] = 32
    return kind, add


def chunk_hashes(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each chunk."""
    size = ends - begins
    total = int(size.sum())
    within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    h = codes[np.repeat(begins, size) + within].astype(np.uint64) << np.uint64(32) | within.astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.add.reduceat(h, np.cumsum(size) - size) if total else h


def encode_batch(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, as the library gives for whole texts.

    The tokenizer drops white space and never joins across it, nor across the edge of a run of letters
    and a run of marks. So the units are such runs, in lower case, in chunks of nothing else, and
    other chunks as they are; each different unit is encoded once and remembered by a 64-bit hash.
    Texts with characters that only one side counts as white space, or that may hold a special
    token, are encoded whole.
    """
    memory = _memory(path)
    if len(memory.keys) > CACHE:
        memory.clear()
    whole = [WHOLE.search(t) is not None for t in texts]
    big = "\n".join(["" if w else t for t, w in zip(texts, whole)]) + "\n"
    codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), "<u4")
    table, lower = _tables()
    small = np.minimum(codes, 65535)
    kind = table[small]
    solid = kind > 0
    edge = np.diff(np.concatenate([[False], solid]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ids, total = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(begins):
        odd = np.maximum.reduceat(kind, begins) == 3
        if odd.any():
            size = (ends - begins)[odd]
            kind[np.repeat(begins[odd] - (np.cumsum(size) - size), size) + np.arange(size.sum())] = 4
        low = codes + np.where(kind == 1, lower[small], 0).astype("<u4")
        change = kind[1:] != kind[:-1]
        begins = np.flatnonzero(solid & np.concatenate([[True], change]))
        ends = np.flatnonzero(solid & np.concatenate([change, [True]])) + 1
        which, unique = pd.factorize(chunk_hashes(low, begins, ends))
        missing = np.flatnonzero(memory.find(unique) < 0)
        if len(missing):
            first = np.zeros(len(unique), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            at = first[missing]
            text = low.tobytes().decode("utf-32-le", "surrogatepass")
            cut = zip(begins[at].tolist(), ends[at].tolist())
            memory.add(unique[missing], [text[a:b] for a, b in cut])
        slot = memory.find(unique)[which]
        start = memory.start[slot]
        size = memory.start[slot + 1] - start
        total = np.cumsum(size)
        ids = memory.ids[np.arange(total[-1]) + np.repeat(start - (total - size), size)]
    lengths = np.array([0 if w else len(t) for t, w in zip(texts, whole)]) + 1
    upto = np.concatenate([[0], np.concatenate([[0], total])[np.searchsorted(begins, np.cumsum(lengths))]])
    flat = ids.astype("<u4").tobytes()
    out = [flat[4 * a : 4 * b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
    for i in np.flatnonzero(whole):
        out[i] = np.array(memory.tok.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each document's ids with END_ID at the end,
    cut into pieces of `capacity` where longer. Null text counts as empty: END_ID alone."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in common.small_batches(batches, most=2_000_000):
            rows, owner = [], []
            encoded = encode_batch(["" if t is None else t for t in pdf["text"]], path)
            for i, ids in enumerate(encoded):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    owner.append(i)
                    row = (k // 4 // capacity, k // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
            names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            out = pd.DataFrame(rows, columns=names).astype({"piece": np.int32})
            out.insert(0, "doc_id", common.ids(pdf).take(owner).reset_index(drop=True))
            yield out

    return common.id_and_text(docs).mapInPandas(run, schema)


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[int]:
    """The lengths, each at most as often as `counts` allows, whose sum is largest within `room`.

    Bit s of a state is set when some combination of the lengths seen so far sums to s. States are
    kept for walking back; the search ends as soon as `room` itself is reached.
    """
    mask, full = (1 << (room + 1)) - 1, 1 << room
    states, steps = [1], []
    for length in order:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            now = states[-1] | (states[-1] << length & mask)
            if now == states[-1]:
                break
            steps.append(length)
            states.append(now)
        if states[-1] & full:
            break
    total, chosen = states[-1].bit_length() - 1, []
    for k in range(len(steps), 0, -1):
        if not states[k - 1] >> total & 1:
            chosen.append(steps[k - 1])
            total -= steps[k - 1]
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {length: copies}) that use up the histogram, fullest bins first."""
    counts = {k: v for k, v in histogram.items() if v}
    order = sorted(counts, reverse=True)
    patterns = []
    while order:
        seed = order[0]
        counts[seed] -= 1
        chosen = [seed, *fullest(counts, order, capacity - seed)]
        counts[seed] += 1
        pattern: dict[int, int] = {}
        for length in chosen:
            pattern[length] = pattern.get(length, 0) + 1
        times = min(counts[k] // v for k, v in pattern.items())
        for k, v in pattern.items():
            counts[k] -= v * times
        patterns.append((times, pattern))
        order = [k for k in order if counts[k]]
    return patterns


def places(patterns: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """Per length: from which ordinal on a pattern takes its pieces, and where they lie in its bins."""
    rows, bin_id, used = [], 0, {}
    for times, pattern in patterns:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, bin_id, copies, offset))
            used[length] = first + times * copies
            offset += length * copies
        bin_id += times
    return pd.DataFrame(rows, columns=["length", "first", "bin", "copies", "offset"])


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (doc_id, piece, length, ...) with sequence_id and offset; offsets in a sequence have no gaps.

    Ties among pieces of one length fall anyhow; repeated rows get places of their own. Empty table:
    empty result.
    """
    spark = cut.sparkSession
    row = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    cut = common.materialize(cut.withColumn("_salt", F.pmod(row, F.lit(SALTS)).cast("int")), "pieces")
    full, rest = cut.where(F.col("length") == capacity), cut.where(F.col("length") < capacity)
    counts = rest.groupBy("length").count().collect()  # fewer than capacity rows
    ways = [(r["length"], -(-r["count"] // IN_GROUP)) for r in counts]
    ways = F.broadcast(spark.createDataFrame(ways, "length long, _ways int"))
    salted = rest.join(ways, "length").withColumn("_salt", F.pmod("_salt", "_ways").cast("int")).drop("_ways")
    sizes = salted.groupBy("length", "_salt").count()
    found = [tuple(r) for r in sizes.collect()]  # capacity rows and one for IN_GROUP pieces at most
    histogram: dict[int, int] = {}
    starts: dict[tuple[int, int], int] = {}
    for length, s, n in sorted(found):
        starts[length, s] = histogram.get(length, 0)
        histogram[length] = starts[length, s] + n
    table = places(plan(histogram, capacity)).sort_values(["length", "first"])
    sent = spark.sparkContext.broadcast((table, starts))  # bounded like `found`
    others = [c for c in cut.columns if c not in ("sequence_id", "offset", "_salt")]
    fields = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in others) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, starts = sent.value
        length, first = table["length"].to_numpy(), table["first"].to_numpy()
        bins, copies, offset = (table[c].to_numpy() for c in ("bin", "copies", "offset"))
        span = np.int64(1) << 40
        keys = length * span + first
        for batch in batches:
            mine, salts, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_salt", "_rank"))
            base = np.fromiter((starts[k] for k in zip(mine.tolist(), salts.tolist())), np.int64, len(mine))
            ordinal = rank.astype(np.int64) - 1 + base
            at = np.searchsorted(keys, mine * span + ordinal, side="right") - 1
            within = ordinal - first[at]
            made = [bins[at] + within // copies[at], offset[at] + within % copies[at] * mine]
            kept = [batch.column(c) for c in others] + [pa.array(x, pa.int64()) for x in made]
            yield pa.RecordBatch.from_arrays(kept, names=[*others, "sequence_id", "offset"])

    ranked = salted.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    )
    alone = (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    return ranked.mapInArrow(place, schema).unionByName(full.select(*[f"`{c}`" for c in others], *alone))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Documents are encoded, ended with END_ID and cut only where longer than `capacity`. Null text
    counts as empty; null doc_id and repeated rows are packed like others; columns beside doc_id
    and text are not read.
    """
    return pack(pieces(docs, path, capacity, with_ids), capacity)
