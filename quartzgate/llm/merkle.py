"""A Merkle manifest of a table: a node store on disk, built level by level, and inclusion proofs from it.

Leaves are sorted into runs on disk, numbered within their tree (a source) and handed on in blocks of BLOCK consecutive
ones. A block is a stream in which each level reads the one below in order, BLOCK = ARITY ** LEVELS leaves giving one node
LEVELS higher; all nodes go to Parquet files that are partitioned by level. The nodes of the last level are the leaves
of the next pass, so 1e11 leaves take five. The tops of the trees are the leaves of one more tree.

Proofs come from the store the other way: the nodes of a block's levels and the proof of the block's own node, sorted by
coordinate (tree, block, level, number), pass by in one merged stream. No task holds more than a block, whatever share of
the rows a tree has, and only one row for each run is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import common

ARITY, LEVELS = 3, 5
BLOCK = ARITY**LEVELS
#: Rows that a worker hands on at once.
ROWS = 2048
#: One step of a proof: the node's place among its siblings, and the others' digests from left to right.
STEP = "struct<at:int,others:array<string>>"
_STEP = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in front, so that neighbours can't be confused; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[str], **instead: Column) -> Column:
    """The digest of a row's columns, in that order; `instead` gives some of them another value."""
    return digest(*[field(instead.get(c, F.col(f"`{c}`"))) for c in columns])


def tree_key(source: Column) -> Column:
    """A binary key that sorts as the sources do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.unhex(F.lit("01")), source.cast("string").cast("binary")), F.unhex(F.lit("")))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with idx, the number of each within its `tree` in that order, from 0. Rows that tie in all of it are alike.

    Rows are sorted into runs by range, written with their number in the run, and a tree that goes on over several runs
    starts in each with the rows before; that is at most one tree for each run, so one row for each is broadcast."""
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    keys = ["tree", *order, "_salt"]
    runs = salted.repartitionByRange(common.parts(rows.sparkSession), *keys).sortWithinPartitions(*keys).drop("_salt")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            trees = batch.column("tree").dictionary_encode()
            codes = trees.indices.to_numpy()
            fresh = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            at = np.arange(n) - np.repeat(fresh, np.diff(fresh, append=n))
            if trees[0].as_py() == last:
                at[: fresh[1] if len(fresh) > 1 else n] += carried
            last, carried = trees[n - 1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, run, np.int32)), pa.array(at)], names=[*batch.schema.names, "run", "at"])

    schema = StructType([*runs.schema.fields, StructField("run", IntegerType()), StructField("at", LongType())])
    held = common.materialize(runs.mapInArrow(count, schema), name)
    sizes = held.groupBy("tree", "run").agg((F.max("at") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("tree", "run", before.alias("offset")).where("offset is not null")
    placed = held.join(F.broadcast(offsets), ["tree", "run"], "left")
    return placed.withColumn("idx", F.col("at") + F.coalesce("offset", F.lit(0))).drop("run", "at", "offset")


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[bytes, int, list[tuple]]]:
    """(tree, block, rows) of a stream that is sorted by them."""
    held: list[tuple] = []
    at: tuple | None = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if (row[0], row[1]) != at:
                if at is not None:
                    yield *at, held
                at, held = (row[0], row[1]), []
            held.append(row)
    if at is not None:
        yield *at, held


def climb(rows: DataFrame, base: int, name: str) -> DataFrame:
    """The nodes (level, tree, idx, digest, ends, top) above the rows (tree, idx, digest) of level `base`, LEVELS of them. A
    tree of fewer than BLOCK rows `ends` here: its last node comes once more, as `top`."""
    block = F.expr(f"idx div {BLOCK}")
    dealt = rows.select("tree", block.alias("block"), "idx", "digest").repartition(common.parts(rows.sparkSession), "tree", "block")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(6)]

        def add(*row) -> None:
            for column, value in zip(out, row):
                column.append(value)

        def batch() -> pa.RecordBatch:
            types = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
            made = [pa.array(c, t) for c, t in zip(out, types)]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(made, names=["level", "tree", "idx", "digest", "ends", "top"])

        for tree, number, members in _blocks(batches, ["tree", "block", "digest"]):
            nodes, height = [m[2].hex() for m in members], 0
            small = number == 0 and len(nodes) < BLOCK
            first = number * BLOCK
            while height < LEVELS and not (small and len(nodes) == 1):
                nodes = [_hash(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
                height, first = height + 1, first // ARITY
                for i, node in enumerate(nodes):
                    add(base + height, tree, first + i, bytes.fromhex(node), small, False)
            if small:
                add(base + height, tree, 0, bytes.fromhex(nodes[0]), True, True)
            if len(out[0]) >= ROWS:
                yield batch()
        yield batch()

    nodes = dealt.sortWithinPartitions("tree", "block", "idx").mapInArrow(up, "level int, tree binary, idx long, digest binary, ends boolean, top boolean")
    return common.materialize(nodes, name, by="level")


class Store:
    """The levels of a forest: for each pass its rows (tree, idx, digest, and what `items` names) and the nodes above."""

    def __init__(self, rows: DataFrame, items: list[str], name: str) -> None:
        self.items, self.passes = items, []
        most = rows.agg(F.max("idx")).first()[0]
        left = -1 if most is None else most + 1
        while left >= 0:
            nodes = climb(rows, LEVELS * len(self.passes), name)
            self.passes.append((rows, nodes))
            level = LEVELS * len(self.passes)
            rows = nodes.where((F.col("level") == level) & ~F.col("ends"))
            left = -(-left // BLOCK) if left >= BLOCK else -1

    def tops(self) -> DataFrame:
        """(tree, digest, pass_no) of the tops of all trees."""
        each = [n.where("top").select("tree", "digest", F.lit(i).alias("pass_no")) for i, (_, n) in enumerate(self.passes)]
        return reduce(DataFrame.unionByName, each)

    def levels(self) -> DataFrame:
        """(level, tree, idx, digest) of all nodes, those of level 0 being the leaves."""
        return reduce(DataFrame.unionByName, [self.passes[0][0].select(F.lit(0).alias("level"), "tree", "idx", "digest"), *[n.where("not top").select("level", "tree", "idx", "digest") for _, n in self.passes]])

    def proofs(self, crown: DataFrame) -> DataFrame:
        """The rows of the first pass with `proof`, the steps from the leaf up, and the columns of `crown` (tree, proof,
        subroot, root), whose proof goes on from the top of the tree."""
        tops = self.tops()
        above = None
        for number in range(len(self.passes) - 1, -1, -1):
            rows, nodes = self.passes[number]
            ends = tops.where(F.col("pass_no") == number).select("tree")
            upper = crown.join(ends, "tree").select("tree", F.lit(0).cast("long").alias("block"), "proof", "subroot", "root")
            if above is not None:
                upper = upper.unionByName(above.select("tree", F.col("idx").alias("block"), "proof", "subroot", "root"))
            above = self._extract(rows, nodes, upper, LEVELS * number, self.items if number == 0 else [])
        return above

    @staticmethod
    def _extract(rows: DataFrame, nodes: DataFrame, upper: DataFrame, base: int, items: list[str]) -> DataFrame:
        """Merge a pass's rows with the nodes of its levels and the proofs from above, by coordinate."""
        none = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in items}
        no_proof = [F.lit(None).cast(f"array<{STEP}>").alias("proof"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root")]

        def node_rows(df: DataFrame, height: Column, given: list[str]) -> DataFrame:
            span = F.element_at(F.array(*[F.lit(BLOCK // ARITY**h) for h in range(LEVELS)]), (height + 1).cast("int"))
            return df.select("tree", F.floor(F.col("idx") / span).alias("block"), (LEVELS - height).cast("int").alias("ord"), "idx", "digest", *no_proof, *[F.col(c) if c in given else none[c] for c in items])

        inner = nodes.where((F.col("level") < base + LEVELS) & ~F.col("top"))
        union = node_rows(rows, F.lit(0), items).unionByName(node_rows(inner, F.col("level") - base, []))
        lead = upper.select("tree", "block", F.lit(0).alias("ord"), F.lit(0).cast("long").alias("idx"), F.lit(None).cast("binary").alias("digest"), "proof", "subroot", "root", *none.values())
        dealt = union.unionByName(lead).repartition(common.parts(rows.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "ord", "idx")
        columns = ["tree", "block", "ord", "idx", "digest", "proof", "subroot", "root", *items]
        out_schema = f"tree binary, idx long, digest string, proof array<{STEP}>, subroot string, root string"
        types = [pa.binary(), pa.int64(), pa.string(), None, pa.string(), pa.string()]
        item_types = [rows.schema[c].dataType.simpleString() for c in items]
        schema = ", ".join([out_schema, *[f"`{c}` {t}" for c, t in zip(items, item_types)]])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds: list = []

            def noted() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    kinds[:] = [batch.schema.field(c).type for c in items]
                    yield batch

            made: list[list] = [[] for _ in range(5 + len(items))]
            places: list[int] = []
            others: list[str] = []
            step_ends, row_ends = [0], [0]

            def batch() -> pa.RecordBatch:
                steps = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.ListArray.from_arrays(pa.array(step_ends, pa.int32()), pa.array(others, pa.string()))], names=["at", "others"])
                proof = pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), steps)
                plain = [pa.array(c, t) for c, t in zip(made, [types[0], types[1], types[2], types[4], types[5], *kinds])]
                found = pa.RecordBatch.from_arrays([*plain[:3], proof.cast(_STEP), *plain[3:]], names=["tree", "idx", "digest", "proof", "subroot", "root", *items])
                for column in (*made, places, others):
                    column.clear()
                step_ends[:], row_ends[:] = [0], [0]
                return found

            for tree, number, members in _blocks(noted(), columns):
                head = members[0]
                shared = [(s["at"], s["others"]) for s in head[5]]
                levels: list[list[str]] = [[] for _ in range(LEVELS)]
                for m in members[1:]:
                    levels[LEVELS - m[2]].append(m[4].hex())
                # a tree that ends in this block has its last level where one node is left
                ends = number == 0 and len(levels[0]) < BLOCK
                height = next((h for h in range(LEVELS) if ends and len(levels[h]) == 1), LEVELS)
                for i, m in enumerate(members[len(members) - len(levels[0]) :]):
                    at = i
                    for h in range(height):
                        start = at - at % ARITY
                        group = levels[h][start : start + ARITY]
                        places.append(at - start)
                        others += group[: at - start]
                        others += group[at - start + 1 :]
                        step_ends.append(len(others))
                        at //= ARITY
                    for place, rest in shared:
                        places.append(place)
                        others += rest
                        step_ends.append(len(others))
                    row_ends.append(len(places))
                    for column, value in zip(made, (m[0], m[3], m[4].hex(), head[6], head[7], *m[8:])):
                        column.append(value)
                if len(made[0]) >= ROWS:
                    yield batch()
            if made[0]:
                yield batch()

        return dealt.mapInArrow(merge, schema)


def folded(start: Column, proof: Column) -> Column:
    """The root that a proof leads to from a leaf's digest."""

    def step(node: Column, s: Column) -> Column:
        before = F.slice(s["others"], F.lit(1), s["at"])
        after = F.slice(s["others"], s["at"] + 1, F.greatest(F.size(s["others"]) - s["at"], F.lit(0)))
        return digest(F.array_join(before, ""), node, F.array_join(after, ""))

    return F.aggregate(proof, start, step)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, one after the other."""
    return digest(F.array_join(F.flatten(F.transform(proof, lambda s: s["others"])), ""))


class Manifest:
    """The manifest of a table.

    sources: the store of the trees of the sources; roots: that of the tree over their tops."""

    def __init__(self, leaves: DataFrame, items: list[str]) -> None:
        self.sources = Store(numbered(leaves, ["doc_id", "digest"], "merkle-leaves"), items, "merkle-nodes")
        self.roots = None
        if self.sources.passes:
            tops = self.sources.tops().select(F.unhex(F.lit("")).alias("tree"), "digest", F.col("tree").alias("key"))
            self.roots = Store(numbered(tops, ["key"], "merkle-tops"), ["key"], "merkle-top-nodes")

    def proofs(self) -> DataFrame:
        """A row for each leaf: tree, idx, digest, proof, subroot, root and the items."""
        digests = F.lower(F.hex("digest"))
        no_steps = F.array().cast(f"array<{STEP}>").alias("proof")
        crown = self.roots.tops().select("tree", no_steps, digests.alias("subroot"), digests.alias("root"))
        top = self.roots.proofs(crown)
        return self.sources.proofs(top.select(F.col("key").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(docs: DataFrame, columns: list[str] = COLUMNS, **items: Column) -> Manifest:
    """The manifest of `docs`: a tree for each source, whose leaves are the digests of the columns, by ascending doc_id, and
    a tree over the trees' tops, by source.

    A null doc_id comes before all others and rows of one doc_id follow each other by digest; a null source is a source
    of its own before all others; null fields count as `-`, empty ones as `0:`. Other columns take no part. `items` are
    further columns that travel with the leaves. An empty table has no root.
    """
    leaves = docs.select(
        tree_key(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf(columns)).alias("digest"),
        *[c.alias(n) for n, c in items.items()],
    )
    return Manifest(common.materialize(leaves, "merkle-digests"), ["doc_id", *items])


def verify_tampered(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Rows whose id has an even CRC-32 are
    tampered with: their text loses its line breaks; a null text or id stays. folded_root is what the row as it is now
    and the siblings of the manifest lead to. Empty table: empty result."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(hit & F.col("text").contains("\n"), F.unhex(leaf(COLUMNS, text=F.translate("text", "\n", ""))))
    made = manifest(docs, altered=changed)
    if made.roots is None:
        empty = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return docs.sparkSession.createDataFrame([], empty)
    start = F.coalesce(F.lower(F.hex("altered")), F.col("digest"))
    rows = made.proofs().select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(start, F.col("proof")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
