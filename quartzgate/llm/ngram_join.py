"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

Sets of shingle hashes are banded by size, so that linked sets lie in one band or in neighbours; a
tile holds a band and the one above it. In a tile the hash space is cut into more parts than linked
sets can differ in elements, so linked sets agree on at least one part: sets that share a part are
the tile's candidates, and all other pairs need no look. Equal sets are one node from the start.

Parts meet as packed postings, and those that the same sets share count as one. Each is linked first
to the member that meets most others; the components that arise leave few open questions, namely
parts whose members are still in different ones. Their members meet in tiles of bounded size. In both
steps bit counts of hashed bitmaps bound the overlap from above, and only what passes the bound has
its exact sorted arrays brought together and intersected.

No pair that could be linked is skipped unless both ends are connected already, so components are
exact. A set whose parts are too often empty for the argument above is cut anew with other seeds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, postings, shingles

#: Shingle length and threshold of near-duplicate stages where no contract says otherwise.
WORDS, NUM, DEN = 5, 80, 100
#: Sets whose keys are made at once, and bits of an element's hash within one of them.
ROWS, HASH = 1 << 20, 44
#: Seeds that a set tries before its empty parts count, too.
SEEDS = 4
#: Least and most bytes of the bitmap with which blocks are compared, and members of a block.
BITMAP, MOST_BITMAP, BLOCK = 64, 16384, 1024
#: Bits of the filter that names the documents whose sets are read again: fixed at 16 MB.
NEEDED_BITS = 1 << 27
#: Members of a part up to which parts with the same members are made one, and members in a row of a larger one.
FEW, IN_ROW = 64, 4096
#: Sets that a task remembers, so that their copies there are not sent again.
REMEMBERED = 1_000_000
#: Ids of documents that go that are broadcast at most (8 bytes each); more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def bands(num: int, den: int, upto: int) -> np.ndarray:
    """The largest size of each band, up to the band that holds `upto`."""
    ends, low = [], 1
    while low <= upto:
        ends.append(max(low, low * den // num))
        low = ends[-1] + 1
    return np.array(ends, np.int64)


def cuts(high: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts, most elements in which linked sets can differ) of tiles whose smaller sets reach `high`."""
    differ = high * (den - num) // num
    return differ + 1 + np.where(differ < 4, 0, 1 + differ // 50), differ


def set_keys(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the set that each belongs to): the keys under which sets meet others, one for each part that
    isn't empty, in their band's tile and in the one below."""
    size = np.array([len(s) for s in sets], np.int64)
    high = bands(num, den, int(max(size, default=1)))
    band = np.searchsorted(high, size)
    keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start in range(0, len(sets), ROWS):
        own = slice(start, start + ROWS)
        for k, r in _keys_of(sets[own], size[own], band[own], high, num, den):
            keys.append(k)
            rows.append(r + start)
    return np.concatenate(keys), np.concatenate(rows)


def _keys_of(sets, size, band, high, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    whole = np.concatenate([*sets, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(sets)), size)
    tiles = [(band - d, *cuts(high[np.maximum(band - d, 0)], num, den), (band >= d) & (size > 0)) for d in (0, 1)]
    low = np.uint64((1 << HASH) - 1)
    for seed in range(SEEDS):
        todo = tiles[0][3] | tiles[1][3]
        if not todo.any():
            return
        some = todo[row]
        # sorted by set, then by hash: both in one number
        both = np.sort((row[some].astype(np.uint64) << np.uint64(HASH)) | (shingles.mix(whole[some], seed + 1) >> np.uint64(64 - HASH)))
        r, h = (both >> np.uint64(HASH)).astype(np.int64), both & low
        each, top = shingles.mix(h, 77), h >> np.uint64(HASH - 32)
        for tile, parts, differ, open_ in tiles:
            part = (top * parts[r].astype(np.uint64)) >> np.uint64(32)
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (r[1:] != r[:-1])])
            first = np.flatnonzero(new)
            content = np.add.reduceat(each, first)
            own, part = r[first], part[first]
            wanted = open_[own]
            tag = ((tile[own] * SEEDS + seed).astype(np.uint64) << np.uint64(40)) + part
            yield shingles.mix(content ^ shingles.mix(tag, 5))[wanted], own[wanted]
            enough = np.bincount(own, minlength=len(sets)) > differ
            if seed == SEEDS - 1:
                for i in np.flatnonzero(open_ & ~enough).tolist():
                    gone = np.setdiff1d(np.arange(parts[i], dtype=np.uint64), part[own == i])
                    tag = (np.uint64(int(tile[i]) * SEEDS + SEEDS) << np.uint64(40)) + gone
                    yield shingles.mix(shingles.mix(tag, 9)), np.full(len(gone), i)
            open_ &= ~enough


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each element's hash, about four bits an element; a power of two bytes."""
    size = min(MOST_BITMAP, max(BITMAP, 1 << int(len(s) // 2).bit_length()))
    bits = np.zeros(size * 8, bool)
    bits[(s & s.dtype.type(size * 8 - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(bits: bytes, size: int) -> bytes:
    """The bitmap that the same elements have in `size` bytes."""
    if len(bits) == size:
        return bits
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0).tobytes()


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def described(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Rows of two kinds. Documents: doc_id, n, node, with key null; without words or doc_id, node is null. Parts that
    several nodes share: key, nodes, how many parts of these nodes the row stands for (times), and whether
    it is all of these parts (whole); rows of one key that isn't are parts of one list."""
    held = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    count = postings.segments(spark, postings.words(held) * 2 * (den - num) / num)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = postings.Sender(1, count), set()
        for at, part in enumerate(common.text_slices(batches)):
            sets = shingles.sets(part.column("text").to_pylist(), k)
            sizes = np.array([len(s) for s in sets], np.int64)
            ids = part.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            nodes = np.array([_node(s) for s in sets], np.int64)
            about = postings.packed(ids.fill_null(0).to_numpy(), known.view(np.uint8), sizes, nodes)
            yield postings.row(0, at % count, len(sets), about)
            fresh = []
            for i in np.flatnonzero(known & (sizes > 0)).tolist():
                if int(nodes[i]) not in seen:
                    seen.add(int(nodes[i]))
                    fresh.append(i)
            if len(seen) > REMEMBERED:
                seen.clear()
            keys, row = set_keys([sets[i] for i in fresh], num, den)
            yield from out.add(keys, nodes[np.array(fresh, np.int64)][row])
        yield from out.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        received = postings.Receiver([np.uint64, np.int64], once=True)
        for batch in batches:
            for kind, n, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "n", "packed"))):
                if kind == 0:
                    yield _documents(raw, n)
                else:
                    for found in received.add(n, raw):
                        yield from shared_parts(found, _TYPES[:3], _NAMES)
        for found in received.finish():
            yield from shared_parts(found, _TYPES[:3], _NAMES)
        common.trim()

    sent = held.mapInArrow(send, postings.SCHEMA)
    return postings.dealt(sent, count).mapInArrow(meet, DESCRIBED)


#: A document in a packed row: doc_id, whether it has one, size of its set, node.
ABOUT = [np.int64, np.uint8, np.int64, np.int64]
DESCRIBED = "doc_id long, n long, node long, key long, times long, whole boolean, nodes array<long>"
_NAMES = ["doc_id", "n", "node", "key", "times", "whole", "nodes"]
_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int64())]


def _documents(raw: bytes, count: int) -> pa.RecordBatch:
    ids, known, n, node = postings.unpacked(raw, count, ABOUT)
    known = known.astype(bool)
    made = [pa.array(ids, mask=~known), pa.array(n), pa.array(node, mask=~known | (n == 0))]
    return pa.RecordBatch.from_arrays([*made, *(pa.nulls(count, t) for t in _TYPES[3:])], names=_NAMES)


def shared_parts(found: postings.Shared, others: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Small parts under a hash of their members, each once with how many of them there are; others in rows. Columns:
    nulls of the types `others`, then key, times, whole, nodes."""
    key, node = found.columns
    small = found.whole & (found.sizes <= FEW)
    whose = np.repeat(small, found.sizes)
    blocks = []
    if small.any():
        nodes, sizes = node[whose], found.sizes[small]
        first = np.cumsum(sizes) - sizes
        name = shingles.mix(np.add.reduceat(shingles.mix(nodes.view(np.uint64), 21), first) + sizes.astype(np.uint64), 22)
        name, at, times = np.unique(name, return_index=True, return_counts=True)
        sizes = sizes[at]
        inner = np.arange(int(sizes.sum())) + np.repeat(first[at] - (np.cumsum(sizes) - sizes), sizes)
        blocks.append((name, times, np.ones(len(name), bool), sizes, nodes[inner]))
    if not small.all():
        key, node = key[~whose], node[~whose]
        sizes = found.sizes[~small]
        rows = -(-sizes // IN_ROW)
        within = np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows)
        cut = np.minimum(IN_ROW, np.repeat(sizes, rows) - within * IN_ROW)
        first = np.cumsum(sizes) - sizes
        blocks.append((np.repeat(key[first], rows), np.ones(len(cut), np.int64), np.zeros(len(cut), bool), cut, node))
    for name, times, whole, sizes, nodes in blocks:
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(nodes))
        made = [pa.array(name.view(np.int64)), pa.array(times.astype(np.int64)), pa.array(whole), lists]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(name), t) for t in others), *made], names=names)


def members_of(parts: DataFrame) -> DataFrame:
    """Rows (key, node, times) of shared parts (key, times, whole, nodes), those with the same members as one."""
    one = parts.where("whole").groupBy("key").agg(F.sum("times").alias("times"), F.first("nodes").alias("nodes"))
    rest = parts.where("not whole").select("key", "times", "nodes")
    return one.unionByName(rest).select("key", F.explode("nodes").alias("node"), "times")


def filter_of(places: DataFrame) -> bytes:
    """The filter, of fixed size and compressed, of `places` (at): numbers from 0 below NEEDED_BITS."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits: dict[int, np.ndarray] = {}
        for pdf in batches:
            for segment, own in pdf.groupby("segment"):
                bits.setdefault(int(segment), np.zeros(8192, bool))[own["at"].to_numpy()] = True
        yield pd.DataFrame([(s, np.packbits(b).tobytes()) for s, b in bits.items()], columns=["segment", "bits"])

    at = places.select("at").distinct()
    at = at.select((F.col("at") / 8192).cast("int").alias("segment"), (F.col("at") % 8192).cast("int").alias("at"))
    packed = at.repartition(common.parts(places.sparkSession), "segment").mapInPandas(pack, "segment int, bits binary").collect()
    whole = np.zeros(NEEDED_BITS // 8, np.uint8)
    for segment, bits in packed:
        whole[segment * 1024 : (segment + 1) * 1024] = np.frombuffer(bytes(bits), np.uint8)
    return zlib.compress(whole.tobytes(), 1)


def passes(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def among(docs: DataFrame, ids: DataFrame, make, schema: str) -> DataFrame:
    """make(slices), `schema`, over Arrow slices (doc_id, text) of the rows whose doc_id is in `ids` (doc_id), and maybe
    a few that aren't. Texts don't move: up to BROADCAST_IDS ids are sent to them, of more a filter of fixed size."""
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    if ids.count() <= BROADCAST_IDS:
        found = known.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
        return found.mapInArrow(lambda batches: make(common.text_slices(batches)), schema)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(NEEDED_BITS))
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(ids.select(spread.alias("at"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        some = (b.filter(pa.array(passes(filled, b.column("at").to_numpy()))) for b in batches)
        yield from make(common.text_slices(some))

    return known.withColumn("at", spread).mapInArrow(run, schema)


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int, column: str) -> DataFrame:
    """Rows (node, n, column) of the documents in `wanted` (doc_id, node): bits, the bitmap, or s, the sorted array."""

    def run(slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices:
            found = shingles.sets(part.column("text").to_pylist(), k)
            made = {
                "doc_id": part.column("doc_id"), "node": pa.array([_node(s) for s in found], pa.int64()),
                "n": pa.array([len(s) for s in found], pa.int64()),
                column: pa.array([bitmap(s) if column == "bits" else s.tobytes() for s in found], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(made)

    found = among(docs, wanted, run, f"doc_id long, node long, n long, {column} binary")
    return found.join(wanted, ["doc_id", "node"], "left_semi").dropDuplicates(["node"]).select("node", "n", column)


def bounded(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and bit counts of info (node, n, bits) don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            need = -(-num * (x + y) // (num + den))
            open_ = np.minimum(x, y) >= need
            for i in np.flatnonzero(open_).tolist():
                p, q = batch.column("bits")[i].as_py(), batch.column("others")[i].as_py()
                size = min(len(p), len(q))
                p, q = (np.frombuffer(folded(v, size), np.uint64) for v in (p, q))
                apart = np.bitwise_count(p & ~q).sum(), np.bitwise_count(q & ~p).sum()
                open_[i] = min(x[i] - int(apart[0]), y[i] - int(apart[1])) >= need[i]
            yield batch.select(["a", "b"]).filter(pa.array(open_))

    described = info.select("node", "n", "bits")
    one = pairs.join(described.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("others")), "b")
    both = one.join(described.withColumnRenamed("node", "a"), "a").select("a", "b", "n", "bits", "m", "others")
    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, arrays: DataFrame, num: int, den: int, kind=np.uint64) -> DataFrame:
    """The pairs (a, b) whose sets, sorted arrays (node, s) of `kind`, are linked. The array of b is brought to a's, so
    a should be the one with many partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("s"), batch.column("t"))):
                x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                need = -(-num * (len(x) + len(y)) // (num + den))
                both = np.sort(np.concatenate([x, y]))
                linked[i] = np.count_nonzero(both[1:] == both[:-1]) >= need
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    one = pairs.join(arrays.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
    both = one.join(arrays.select(F.col("node").alias("a"), "s"), "a").select("a", "b", "s", "t")
    return both.mapInArrow(run, "a long, b long")


def compare_block(i: int, j: int, own, node, comp, n, bits, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one tile that differ in component and pass the bounds of size and bitmap."""
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    if not len(left) or not len(right) or (comp == comp[0]).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = min(map(len, bits))
    all_bits = np.frombuffer(b"".join([folded(b, size) for b in bits]), np.uint64).reshape(len(bits), -1)
    filled = np.bitwise_count(all_bits).sum(1, dtype=np.int64)
    a, b = [], []
    step = max(1, 2_000_000 // (len(right) * all_bits.shape[1]))
    for k in range(0, len(left), step):
        mine = left[k : k + step]
        both = np.bitwise_count(all_bits[mine][:, None] & all_bits[right][None]).sum(2, dtype=np.int64)
        x, y = n[mine][:, None], n[right][None]
        most = np.minimum(x - filled[mine][:, None] + both, y - filled[right][None] + both)
        need = -(-num * (x + y) // (num + den))
        hit = (comp[mine][:, None] != comp[right][None]) & (most >= need) & (np.minimum(x, y) >= need)
        if i == j:
            hit &= mine[:, None] < right[None]
        p, q = np.nonzero(hit)
        a.append(node[mine[p]])
        b.append(node[right[q]])
    return np.concatenate(a), np.concatenate(b)


def spanning(pairs: list[tuple[int, int]], sets: dict[int, set], num: int, den: int) -> list[tuple[int, int]]:
    """Of the pairs whose sets are linked, enough to connect what all of them connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        p, q = find(a), find(b)
        if p != q:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                root[p] = q
                out.append((a, b))
    return out


def _blocks(members: DataFrame, num: int, den: int, kind=None) -> DataFrame:
    """Pairs (a, b) of members (key, node, comp, n, bits, size) that share a key but no component, may be
    linked by size, and pass the bound of their bitmaps; compared in tiles of about BLOCK by BLOCK.

    With `kind` members also have their sets, s, as arrays of it, and a tile gives links enough to
    connect what is linked in it.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("own", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = placed.withColumn("other", other).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n", "bits",
        *(["s"] if kind else []),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        seen: set[tuple[int, int]] = set()

        def tiles_of(pdf: pd.DataFrame, upto: int) -> pd.DataFrame:
            key, i, j, own, node, comp, n = (pdf[c].to_numpy() for c in ("key", "i", "j", "own", "node", "comp", "n"))
            bits = pdf["bits"].tolist()
            whole = pdf["s"].tolist() if kind else []
            same = (key[1:upto] == key[: upto - 1]) & (i[1:upto] == i[: upto - 1]) & (j[1:upto] == j[: upto - 1])
            starts = [0, *(np.flatnonzero(~same) + 1).tolist(), upto]
            out: list[tuple[int, int]] = []
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a > 1:
                    x, y = compare_block(i[a], j[a], own[a:b], node[a:b], comp[a:b], n[a:b], bits[a:b], num, den)
                    found = list(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
                    if kind and found:
                        named = {v for pair in found for v in pair}
                        sets = {v: set(np.frombuffer(w, kind).tolist()) for v, w in zip(node[a:b].tolist(), whole[a:b]) if v in named}
                        found = spanning(found, sets, num, den)
                    out += found
            fresh = set(out) - seen
            if len(seen) < 1_000_000:
                seen.update(fresh)
            return pd.DataFrame(list(fresh), columns=["a", "b"]).astype(np.int64)

        for pdf in batches:
            pdf = pdf if carry is None else pd.concat([carry, pdf], ignore_index=True)
            if len(pdf):
                last = pdf[["key", "i", "j"]].to_numpy()
                upto = int(np.flatnonzero((last != last[-1]).any(1))[-1]) + 1 if (last != last[-1]).any() else 0
                carry = pdf.iloc[upto:]
                if upto:
                    yield tiles_of(pdf, upto)
        if carry is not None and len(carry):
            yield tiles_of(carry.reset_index(drop=True), len(carry))

    dealt = tiles.repartition(common.parts(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def linked_components(members: DataFrame, info: DataFrame, arrays_of, num: int, den: int, kind=np.uint64) -> DataFrame:
    """Rows (node, component) of all nodes with a link. members: (key, node, times), times telling how many keys the
    row stands for; info: (node, n, bits); arrays_of(nodes) gives (node, s) of the rows (node), sorted arrays of `kind`.

    In each key the member that meets most others over all its keys is the anchor, as an original among
    its edited copies does. Each member is compared with the best of its keys' anchors first. Keys
    whose members are then still in different components have them compared with each other in tiles.
    """
    info = info.select("node", "n", "bits")
    sizes = members.groupBy("key").agg((F.count("*") * F.first("times")).alias("weight"))
    degrees = members.join(sizes, "key").groupBy("node").agg(F.sum("weight").alias("degree"))
    first = members.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top"))
    anchored = members.select("key", "node").join(first, "key").where("node <> top.node")
    best = anchored.groupBy("node").agg(F.max("top").alias("top"))
    stars = best.select(F.col("top.node").alias("a"), F.col("node").alias("b"))

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return common.materialize(verified(pairs, arrays_of(nodes), num, den, kind), name)

    near = common.materialize(bounded(stars, info, num, den), "ngram-near")
    edges = linked(near, "ngram-edges")
    common.release(near)
    first = common.materialize(common.connected_components(edges), "ngram-first")
    known = members.join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    sizes = known.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("one"), F.max("comp").alias("other"))
    open_groups = sizes.where("one < other").select("key", "size")
    still = known.join(open_groups, "key").distinct()
    if kind is np.uint64:
        near = common.materialize(_blocks(still.join(info, "node"), num, den), "ngram-tiles")
        more = linked(near, "ngram-more")
        common.release(near)
    else:  # sets that are small enough to travel with the tiles
        arrays = arrays_of(still.select("node").distinct())
        more = common.materialize(_blocks(still.join(info, "node").join(arrays.select("node", "s"), "node"), num, den, kind), "ngram-more")
    if not more.isEmpty():
        common.release(first)
        first = common.materialize(common.connected_components(edges.unionByName(more)), "ngram-components")
    common.release(edges, more)
    return first


def join(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id.

    A document's set holds its distinct k-word shingles, with fewer words the whole sequence as one.
    Two documents link when den * intersection >= num * union; component_id is the smallest doc_id
    reachable by links, the document's own included. Without words, or with null text, a document is
    linked with nothing. Rows with a null doc_id have a null component and link nothing; repeated
    rows of a doc_id all take part. Other columns are not read. Empty table: empty result.
    """
    seen = common.materialize(described(docs, k, num, den), "ngram-sets")
    each = seen.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), "node")
    parts = seen.where("key is not null").select("key", "times", "whole", "nodes")
    members = common.materialize(members_of(parts), "ngram-members")
    least = each.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = members.select("node").distinct().join(least, "node")
    wanted = common.materialize(wanted, "ngram-wanted")
    info = common.materialize(_sets_of(docs, wanted, k, "bits"), "ngram-bits")
    steps = [members, wanted, info]

    def arrays_of(nodes: DataFrame) -> DataFrame:
        some = common.materialize(wanted.join(nodes, "node", "left_semi"), "ngram-named")
        arrays = common.materialize(_sets_of(docs, some, k, "s"), "ngram-arrays")
        steps.extend([some, arrays])
        return arrays

    components = linked_components(members, info, arrays_of, num, den)
    common.release(*steps)

    # what a class is named by is made for nodes first, of which exact copies are one
    classes = least.join(components, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("class"))
    names = classes.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(names, "class").select("node", "component_id")
    alone = each.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return each.join(named, "node").select(*alone.columns).unionByName(alone)


def keep_one(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of `docs` that stay when one document of each group of linked ones does: the one whose
    doc_id is the component's. Rows with a null doc_id stay, and so do repeated rows of that one."""
    ids = join(docs, k, num, den).where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    ids = common.materialize(ids, "ngram-gone")
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti").select(*docs.columns)
