"""Logistic regressions over words whose numbers never leave the tasks.

The weights of a model are sums of its rows (w = X' a), so a fit needs a number for each row, not for each word, and a step
needs the product of X X' with one vector. Rows lie in blocks. For a product each block sends the sums of its own words to the
parts of the vocabulary, a part adds what the blocks sent and answers each with its words, and the blocks sum up their rows. The
driver gets NUMBERS sums for each model and pass. All models (one for each fold's other rows, one for all) go through the same
passes, each with Newton steps of its own, found by conjugate gradients whose vectors are such sums too. What fits in one block
needs no passes: its task goes through the same steps by itself.

For many words, most of them rare: vectors over more rows than words may grow along what adds up to nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Entries (a row's word) of a block, about; entries that are one block; words of a part, and parts in a task.
ENTRIES, SINGLE, WORDS, PARTS = 1_000_000, 3_000_000, 16_384, 16
#: A gradient of this length ends a fit; Newton steps, and halvings of one, at most.
SLOPE, STEPS, HALVES = 1e-7, 50, 20

#: What a block asks a part, what a part answers (of = -2: the square of its words), and what is kept of a block (of = -1).
ASK, ANSWER = "key long, of int, sender long, at binary, body binary", "key long, of int, body binary"
STATE = "key long, of int, body binary, told array<double>"
BLOCK = "key long, rows int, y binary, fold binary, lengths binary, place binary, tf binary, cuts binary, word binary"
#: Numbers of each row and model: X' a are the weights, X' d the Newton step, X' r and X' p residual and direction of the search
#: for it; with K their products, the last of which a pass makes.
NORM, A, ETA, D, KD, R, P, KP, KR = range(9)
NUMBERS, SQUARE = 11, 5


@dataclass
class Step:
    """What a model does with its numbers before the next product: "start"; "turn", a round of conjugate gradients (the first one is
    `fresh`); "finish", a last round and the Newton step; "back", less of that step."""

    kind: str
    step: float = 0.0
    keep: float = 0.0
    free: float = 0.0
    fresh: bool = False


def apart(spark: SparkSession, n: int) -> list[int]:
    """n numbers that Spark deals out to n partitions, one to each."""
    found: dict[int, int] = {}
    for r in spark.range(0, n * 32 + 64, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect():
        found.setdefault(r["p"], r["id"])
    spare = iter(x for x in range(n * 32 + 64) if x not in found.values())
    return [found[p] if p in found else next(spare) for p in range(n)]


def looked_up(values: list[int], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), place.cast("int") + 1)


def _batch(fields: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in fields.split(", ")))
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, t in zip(columns, kinds)], names=list(names))


def _fields(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names))


def _kept(held: Held, x: np.ndarray, told: list[float]) -> pa.Table:
    return pa.table({
        "key": pa.array([held.key], pa.int64()), "of": pa.array([-1], pa.int32()), "body": pa.array([x.tobytes()], pa.binary()),
        "told": pa.array([told], pa.list_(pa.float64())),
    })


class Held:
    """A block's rows: entries by row, each with the place of its word among the block's words, which lie by part."""

    def __init__(self, table: pa.Table) -> None:
        one = {c: table.column(c)[0].as_py() for c in table.column_names if c != "ids"}
        self.key, self.n = one["key"], one["rows"]
        self.y, self.fold = np.frombuffer(one["y"]), np.frombuffer(one["fold"], np.int32)
        self.place, self.tf = np.frombuffer(one["place"], np.int32).astype(np.intp), np.frombuffer(one["tf"])
        self.lengths = np.frombuffer(one["lengths"], np.int32)
        self.row = np.repeat(np.arange(self.n), self.lengths)
        self.cuts, self.word = np.frombuffer(one["cuts"], np.int64), np.frombuffer(one["word"], np.int32)

    def by_word(self, u: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.place, self.tf * x[self.row], len(self.word)) for x in u])

    def by_row(self, w: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, tf * x[self.place], self.n) for x in w])

    def asks(self, keys: list[int], sums: np.ndarray | None) -> Iterator[tuple]:
        for part in np.flatnonzero(np.diff(self.cuts)):
            here = slice(self.cuts[part], self.cuts[part + 1])
            body = None if sums is None else np.ascontiguousarray(sums[:, here]).tobytes()
            yield keys[part % len(keys)], int(part), self.key, self.word[here].tobytes(), body

    def answered(self, told: pa.Table, m: int) -> np.ndarray:
        """Numbers of the block's words by what parts said of the words asked for, or of all of theirs."""
        out = np.zeros((m, len(self.word)))
        for part, body in zip(told.column("of").to_pylist(), told.column("body").to_pylist()):
            if part >= 0:
                here, said = slice(self.cuts[part], self.cuts[part + 1]), np.frombuffer(body).reshape(m, -1)
                out[:, here] = said if said.shape[1] == here.stop - here.start else said[:, self.word[here]]
        return out


def _state(told: pa.Table, k: int) -> np.ndarray:
    """The block's numbers, (number, model, row)."""
    at = told.column("of").to_pylist().index(-1)
    return np.frombuffer(told.column("body")[at].as_py()).reshape(KR + 1, k, -1).copy()


def _curve(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slope of each row's loss by its log odds, and its curvature."""
    p = 1 / (1 + np.exp(-x[ETA]))
    return (p - y) * own, p * (1 - p) * own


def moved(x: np.ndarray, y: np.ndarray, own: np.ndarray, steps: list[Step | None]) -> None:
    """Bring the numbers x (number, model, row) of a block to the next product, that with r."""
    for m, do in enumerate(steps):
        if do is None:
            continue
        n = x[:, m]
        if do.fresh:
            n[D] = n[KD] = 0
        if do.kind in ("turn", "finish"):
            n[P] = n[R] + do.keep * n[P]
            n[KP] = n[KR] + do.keep * n[KP]
            n[D] += do.step * n[P]
            n[KD] += do.step * n[KP]
        if do.kind == "turn":
            n[R] -= do.step * (n[P] + _curve(n, y, own[m])[1] * (n[KP] + do.free))
            continue
        if do.kind == "finish":
            n[KD] += do.free
            n[A] += n[D]
            n[ETA] += n[KD]
        elif do.kind == "back":
            n[A] -= do.step * n[D]
            n[ETA] -= do.step * n[KD]
        n[P] = n[KP] = 0
        n[R] = -(n[A] + _curve(n, y, own[m])[0])


def numbers(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What the driver is told of a block: NUMBERS sums for each model. The square of X' r, at SQUARE, is what the words say: r may be
    large where X' r is 0, so r' K r would be all rounding."""
    out = []
    for m in range(x.shape[1]):
        n = x[:, m]
        rest, d = _curve(n, y, own[m])
        loss = ((np.maximum(n[ETA], 0) + np.log1p(np.exp(-np.abs(n[ETA]))) - y * n[ETA]) * own[m]).sum()
        out.append([loss, n[A] @ n[ETA], n[A].sum(), rest.sum(), d.sum(), 0.0,
                    d @ n[KR] ** 2, d @ (n[KR] * n[KP]), d @ n[KP] ** 2, d @ n[KR], d @ n[KP]])
    return np.array(out)


class Model:
    """The driver's share of a fit: the intercept, which is a coordinate of its own, and where the Newton step stands."""

    def __init__(self) -> None:
        self.intercept, self.value, self.first, self.steps = 0.0, np.inf, 0.0, 0
        self.turns = self.halves = 0
        self.next: Step | None = Step("start")

    def tell(self, sums: np.ndarray, most: int) -> None:
        """Choose the next step by the sums after the last."""
        loss, a_eta, a_sum, rest, curve, square, rr, rp, pp, r_sum, p_sum = map(float, sums)
        if self.next.kind != "turn":
            value = loss + (a_eta - self.intercept * a_sum) / 2
            if not (self.value == math.inf or value <= self.value + 1e-10 * abs(self.value)) and self.halves < HALVES:  # too far: half the step
                self.by, self.halves = self.by / 2, self.halves + 1
                self.intercept -= self.by * self.d
                self.next = Step("back", self.by)
                return
            slope = math.sqrt(square + rest * rest / curve) if curve else math.nan
            self.first = self.first or slope
            self.value, self.steps = value, self.steps + 1
            if not slope >= SLOPE or self.steps > STEPS:
                self.next = None
                return
            self.goal = max(min(0.1, slope / self.first) * slope, 0.3 * SLOPE)
            self.r, self.p, self.d, self.size, self.long, self.turns = -rest, 0.0, 0.0, 0.0, 0.0, 0
        size = square + self.r * self.r / curve
        keep = size / self.size if self.turns else 0.0
        self.long = square - 2 * keep * self.r * self.p + keep * keep * self.long  # of X' p: r is at right angles to the last direction
        self.p = self.r / curve + keep * self.p
        bent = rr + 2 * keep * rp + keep * keep * pp + 2 * self.p * (r_sum + keep * p_sum) + self.p * self.p * curve
        step = size / (self.long + bent) if size else 0.0
        self.r -= step * (r_sum + keep * p_sum + self.p * curve)
        self.d += step * self.p
        fresh, self.turns, self.size = self.turns == 0, self.turns + 1, size
        if not fresh and (math.sqrt(size) <= self.goal or self.turns > most):
            self.intercept += self.d
            self.by, self.halves = 1.0, 0
            self.next = Step("finish", step, keep, self.d)
        else:
            self.next = Step("turn", step, keep, self.p, fresh)


class Fits:
    """Models fitted to rows (id, _y, fold, slots, tf): weights of 0/1 labels `share` (model, label), each model without its own
    fold. words: (slot, idf by model), `size` of them."""

    def __init__(self, rows: DataFrame, words: DataFrame, size: int, share: np.ndarray, without: list[int]) -> None:
        spark = rows.sparkSession
        cores, self.k, self.size = spark.sparkContext.defaultParallelism, len(without), size
        entries = rows.agg(F.sum(F.size("slots")).alias("n")).first()["n"] or 0
        tasks = 1 if entries <= SINGLE else -(-entries // (cores * ENTRIES)) * cores
        self.parts = max(1, -(-size // WORDS))
        self.width = max(1, -(-size // self.parts))
        self.keys = apart(spark, max(min(self.parts, cores), -(-self.parts // PARTS)))
        self.own = lambda held: np.stack([np.where(held.fold != f, share[m][held.y.astype(int)], 0) for m, f in enumerate(without)])
        dealers, kind = apart(spark, tasks), rows.schema["id"].dataType.simpleString()
        dealt = rows.select("id", "_y", "fold", "slots", "tf", looked_up(dealers, F.pmod(F.xxhash64("id"), F.lit(tasks))).alias("_b"))
        self.blocks = dealt.groupBy("_b").applyInArrow(self._build(), f"{BLOCK}, ids array<{kind}>").repartition(tasks, "key").persist()
        self.idf = session.materialize(self._laid(words), "text-idf")
        self.models = [Model() for _ in without]
        self.single = dealers[0] if tasks == 1 else None
        self.state = self._normed() if self.single is None else None

    @property
    def intercepts(self) -> np.ndarray:
        return np.array([m.intercept for m in self.models])

    def _build(self):
        parts, width = self.parts, self.width

        def build(table: pa.Table) -> pa.Table:
            slots = table.column("slots").combine_chunks()
            slot = slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            words, place = np.unique(slot % parts * width + slot // parts, return_inverse=True)
            arrays = {
                "y": table.column("_y").to_numpy().astype(float), "fold": table.column("fold").to_numpy().astype(np.int32),
                "lengths": slots.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32), "place": place.astype(np.int32),
                "tf": table.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float),
                "cuts": np.searchsorted(words, np.arange(parts + 1) * width).astype(np.int64), "word": (words % width).astype(np.int32),
            }
            ids = table.column("id").combine_chunks()
            out = {"key": table.column("_b").slice(0, 1), "rows": pa.array([len(table)], pa.int32())}
            out |= {n: pa.array([x.tobytes()], pa.binary()) for n, x in arrays.items()}
            return pa.table(out | {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)})

        return build

    def _laid(self, words: DataFrame) -> DataFrame:
        """The words' idf, a message for each part to itself."""
        parts, width, k = self.parts, self.width, self.k

        def lay(table: pa.Table) -> pa.Table:
            idf = np.zeros((k, width))
            idf[:, table.column("slot").to_numpy() // parts] = table.column("idf").combine_chunks().flatten().to_numpy().reshape(-1, k).T
            return pa.table({"key": table.column("key").slice(0, 1), "of": table.column("of").slice(0, 1), "body": pa.array([idf.tobytes()], pa.binary())})

        of = (F.col("slot") % parts).cast("int")
        placed = words.select("slot", "idf", of.alias("of"), looked_up(self.keys, of % len(self.keys)).alias("key"))
        return placed.groupBy("of").applyInArrow(lay, "key long, of int, body binary")

    def _answers(self, asks: DataFrame, active: list[int], sums: bool = True) -> DataFrame:
        """(key, of, body): what each part adds up of its words, times their squared idf, for each block that asked."""
        width = self.width

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, total, asked = {}, {}, []
            for of, sender, at, body in _fields(batches, "of", "sender", "at", "body"):
                if at is None:
                    idf[of] = np.frombuffer(body).reshape(-1, width)[active] ** 2
                    continue
                at = np.frombuffer(at, np.int32)
                asked.append((of, sender, at))
                if sums:
                    if of not in total:
                        total[of] = np.zeros((len(active), width))
                    for mine, more in zip(total[of], np.frombuffer(body).reshape(len(active), -1)):
                        mine[at] += more
            told = {of: idf[of] * total[of] if sums else idf[of] for of, _, _ in asked}
            first = {of: sender for of, sender, _ in asked} if sums else {}
            for of, sender in first.items():  # one of them passes the square on
                yield _batch(ANSWER, [(sender, -2, (told[of] * total[of]).sum(1).tobytes())])
            for of, sender, at in asked:
                yield _batch(ANSWER, [(sender, of, told[of][:, at].tobytes())])

        mine = self.idf.select("key", "of", F.lit(None).cast("long").alias("sender"), F.lit(None).cast("binary").alias("at"), "body")
        return asks.unionByName(mine).repartition(len(self.keys), "key").mapInArrow(meet, ANSWER)

    def _normed(self) -> DataFrame:
        """The state before the first pass: the rows' norms, all else 0."""
        k, keys = self.k, self.keys

        def ask(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_batch(ASK, list(Held(table).asks(keys, None)))])

        def norms(table: pa.Table, told: pa.Table) -> pa.Table:
            held = Held(table)
            x = np.zeros((KR + 1, k, held.n))
            square = held.by_row(held.answered(told, k), held.tf**2)
            x[NORM] = 1 / np.sqrt(np.where(square > 0, square, 1))
            return _kept(held, x, [])

        answers = self._answers(self._blocks().applyInArrow(ask, ASK), list(range(k)), sums=False)
        return session.materialize(self._blocks().cogroup(answers.groupBy("key")).applyInArrow(norms, STATE), "text-state")

    def _blocks(self):
        return self.blocks.groupBy("key")

    def step(self) -> None:
        """One pass: all models that are not done make their next step."""
        k, keys, own, steps = self.k, self.keys, self.own, [m.next for m in self.models]
        active = [m for m in range(k) if steps[m]]

        def ask(table: pa.Table, told: pa.Table) -> pa.Table:
            held, x = Held(table), _state(told, k)
            moved(x, held.y, own(held), steps)
            return pa.Table.from_batches([_batch(ASK, list(held.asks(keys, held.by_word((x[NORM] * x[R])[active]))))])

        def sum_up(table: pa.Table, told: pa.Table) -> pa.Table:
            held, x = Held(table), _state(told, k)
            weight = own(held)
            moved(x, held.y, weight, steps)
            x[KR, active] = x[NORM, active] * held.by_row(held.answered(told, len(active)), held.tf)
            sums = numbers(x, held.y, weight)
            for of, body in zip(told.column("of").to_pylist(), told.column("body").to_pylist()):
                if of == -2:
                    sums[active, SQUARE] += np.frombuffer(body)
            return _kept(held, x, sums.ravel().tolist())

        before = self.state.select("key", "of", "body")
        answers = self._answers(self._blocks().cogroup(before.groupBy("key")).applyInArrow(ask, ASK), active)
        after = self._blocks().cogroup(answers.unionByName(before).groupBy("key")).applyInArrow(sum_up, STATE)
        state = session.materialize(after, "text-state")
        session.release(self.state)
        self.state = state
        told = [r["told"] for r in state.select("told").collect()]  # a row for each block
        self.sums = np.sum(told, 0).reshape(k, NUMBERS)

    def run(self, most: int) -> Fits:
        """Fit all models, with at most `most` turns in a Newton step."""
        if self.single is not None:
            self.state = self._alone(most)
            for m, told in zip(self.models, self.state.first()["told"]):
                m.intercept = told
            return self
        while any(m.next for m in self.models):
            self.step()
            for m, sums in zip(self.models, self.sums):
                if m.next:
                    m.tell(sums, most)
        return self

    def _alone(self, most: int) -> DataFrame:
        """The last state where all rows are one block; told: the intercepts."""
        k, own = self.k, self.own

        def fit(table: pa.Table, told: pa.Table) -> pa.Table:
            held = Held(table)
            square = held.answered(told, k) ** 2
            norm = held.by_row(square, held.tf**2)
            x = np.zeros((KR + 1, k, held.n))
            x[NORM] = 1 / np.sqrt(np.where(norm > 0, norm, 1))
            models, weight = [Model() for _ in range(k)], own(held)
            while any(m.next for m in models):
                moved(x, held.y, weight, [m.next for m in models])
                active = [m for m in range(k) if models[m].next]
                words = held.by_word(x[NORM, active] * x[R, active])
                x[KR, active] = x[NORM, active] * held.by_row(square[active] * words, held.tf)
                sums = numbers(x, held.y, weight)
                sums[active, SQUARE] = (square[active] * words**2).sum(1)
                for m in active:
                    models[m].tell(sums[m], most)
            return _kept(held, x, [m.intercept for m in models])

        words = self.idf.withColumn("key", F.lit(self.single).cast("long")).groupBy("key")
        return session.materialize(self._blocks().cogroup(words).applyInArrow(fit, STATE), "text-state")

    def held_out(self, label: str, kind: str) -> DataFrame:
        """(id, label, fold, probability): what the model without a row's fold says of it."""
        k, free, ids = self.k, self.intercepts, self.blocks.schema["ids"].dataType.elementType.simpleString()

        def tell(table: pa.Table, told: pa.Table) -> pa.Table:
            held, x = Held(table), _state(told, k)
            eta = x[ETA, held.fold, np.arange(held.n)]
            return pa.table({"id": table.column("ids").combine_chunks().flatten(), "_y": held.y, "fold": held.fold, "probability": 1 / (1 + np.exp(-eta))})

        told = self._blocks().cogroup(self.state.groupBy("key")).applyInArrow(tell, f"id {ids}, _y double, fold int, probability double")
        return told.select("id", F.col("_y").cast(kind).alias(label), "fold", "probability")

    def weights(self) -> DataFrame:
        """(slot, weights, idf), both by model."""
        k, keys, parts, width, size = self.k, self.keys, self.parts, self.width, self.size

        def ask(table: pa.Table, told: pa.Table) -> pa.Table:
            held, x = Held(table), _state(told, k)
            return pa.Table.from_batches([_batch(ASK, list(held.asks(keys, held.by_word(x[NORM] * x[A]))))])

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, total = {}, {}
            for of, at, body in _fields(batches, "of", "at", "body"):
                if at is None:
                    idf[of] = np.frombuffer(body).reshape(k, width)
                else:
                    total.setdefault(of, np.zeros((k, width)))[:, np.frombuffer(at, np.int32)] += np.frombuffer(body).reshape(k, -1)
            for of, held in idf.items():
                slot = np.arange(width) * parts + of
                known = slot < size
                rows = [(held * total.get(of, 0.0)).T[known].tolist(), held.T[known].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(slot[known]), *[pa.array(r, pa.list_(pa.float64())) for r in rows]], names=["slot", "weights", "idf"])

        asks = self._blocks().cogroup(self.state.groupBy("key")).applyInArrow(ask, ASK)
        mine = self.idf.select("key", "of", F.lit(None).cast("long").alias("sender"), F.lit(None).cast("binary").alias("at"), "body")
        return asks.unionByName(mine).repartition(len(keys), "key").mapInArrow(weigh, "slot long, weights array<double>, idf array<double>")

    def release(self) -> None:
        self.blocks.unpersist()
        session.release(self.state, self.idf)
