"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a partition's batch are laid end to end as symbols. An index maps the rank of
each adjacent pair to all its positions; active ranks are applied in ascending order, each to all its
positions at once, and the lists of the pairs that arise beside a merge are updated. A merged pair's
own rank always exceeds the ranks of its parts, so ascending order equals word-by-word encoding.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from . import common

#: The byte-level pre-tokenisation: contractions, words, numbers, other marks, white space.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Runs that PATTERN never crosses: non-blank characters with the space before, and blanks.
RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python counts these four as white space, Unicode doesn't; texts that hold them skip RUNS.
ODD = re.compile("[\x1c-\x1f]")
#: Runs that a worker remembers before it starts anew: bounds its memory.
CACHE = 400_000
#: Characters of a batch: each one walks the active ranks once, so few large ones are best.
BATCH_CHARS = 4_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte, as the byte-level vocabulary spells it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """The vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_alphabet()
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.left, self.right = left, right
        self.base = max(vocab.values()) + 1
        key = left * self.base + right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, all words at once, by the pair occurrence index."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        symbol = self.first[raw]
        symbol[ends] = -1  # a wall between words
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        before[0] = n - 1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, where in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(where)
                else:
                    index[r] = [where]
                    heapq.heappush(heap, r)

        post(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b and len(at) > 1:  # in a run of equal symbols every other pair merges, from the left
                joined = np.zeros(len(at), bool)
                joined[1:] = after[at[:-1]] == at[1:]
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[r]
            symbol[gone] = -2
            then = after[gone]
            after[at] = then
            before[then] = at
            left = before[at]
            post(np.unique(np.concatenate([at, left[symbol[left] >= 0]])))
        keep = symbol != -2
        flat = symbol[keep]
        walls = np.flatnonzero(flat == -1)
        return [x[x >= 0] for x in np.split(flat, walls[:-1] + 1)] if len(walls) > 1 else [flat[flat >= 0]]

    def learn(self, runs: set[str]) -> None:
        """Encode the runs that aren't known yet."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [r for r in runs if r not in self.cache]
        pieces = [PATTERN.findall(r) for r in new]
        words = list({p for found in pieces for p in found})
        ids = self.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
        made = {w: x.astype("<u4").tobytes() for w, x in zip(words, ids)}
        for r, found in zip(new, pieces):
            self.cache[r] = b"".join([made[p] for p in found])

    def runs(self, text: str) -> list[str]:
        if ODD.search(text):
            return PATTERN.findall(text)
        return RUNS.findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str]] = []
        for text in texts:
            if self.split is not None and any(s in text for s in self.special):
                parts: list[str] = []
                for piece in self.split.split(text):
                    parts += [piece] if piece in self.special else self.runs(piece)
                cut.append(parts)
            else:
                cut.append(self.runs(text))
        if len(self.cache) > CACHE:
            self.cache.clear()
        need = set().union(*cut) if cut else set()
        self.cache |= {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        self.learn(need)
        # learn() may have cleared the cache before it added this batch's runs
        missing = need - self.cache.keys()
        if missing:
            self.cache |= {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
            self.learn(missing)
        return [b"".join(map(self.cache.__getitem__, runs)) for runs in cut]

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = max(self.bytes_of) + 1
        pieces = [self.bytes_of.get(i, b"") for i in range(size)]
        lengths = np.array([len(p) for p in pieces])
        return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        flat, starts, lengths = self.table
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        size = lengths[at]
        total = int(size.sum())
        shift = np.repeat(starts[at] - (np.cumsum(size) - size), size)
        return flat[np.arange(total) + shift].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; on demand ids (array) and decoded (text).

    Null text counts as empty: no ids, empty decoded text. Special tokens' strings in a text become
    their ids, as the tokenizers library does. Null doc_id stays null; repeated rows give repeated
    results; other columns are not read. Empty table: empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in common.small_batches(batches, most=BATCH_CHARS):
            texts = ["" if t is None else t for t in pdf["text"]]
            ids = c.encode_batch(texts)
            decoded = [c.decode(x) for x in ids]
            out = pd.DataFrame(
                {
                    "doc_id": common.ids(pdf),
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded],
                }
            )
            if with_ids:
                out["ids"] = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
            if with_text:
                out["decoded"] = decoded
            yield out

    return common.id_and_text(docs).mapInPandas(run, schema)
