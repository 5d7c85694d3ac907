"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification. Words are the symbols.

The CGK walk reads a string with a pointer that stays or moves on by a random bit of the symbol and the
step, so two strings at a small edit distance fall into step again after each edit and their walks
differ in few places (Hamming). A repetition draws its own walk and samples some of its steps as a
bucket key; enough repetitions are made to reach the target recall. Only item-sized windows that
can lie within the edit limit are embedded: by the q-gram lemma such a window shares a known number of
word q-grams with its item on nearby diagonals, so none is lost. Collisions are then verified exactly.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared

ITEM_BLOCK = 20_000
SCHEMA = "doc_id long, item_id long, start long, end long, distance long, item_words long"

#: Letters and digits of ASCII and all bytes of longer characters stay (lower-cased); the rest are gaps.
_PLAIN = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _PLAIN[_b] = _b
for _b in range(0x41, 0x5B):
    _PLAIN[_b] = _b + 0x20


def plain_bytes(raw: np.ndarray) -> np.ndarray:
    """Case and ASCII marks taken out, byte for byte; capitals of Latin-1 (two bytes from C3 80 on) are lower-cased too."""
    out = _PLAIN[raw]
    big = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[1:][big] += 0x20
    return out


def repetitions(recall: float, agreement: float, sampled: int) -> int:
    """Repetitions so that two walks that agree in a share ``agreement`` of their steps collide with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled))


class Items:
    """A block of benchmark items with their q-gram index and LSH tables."""

    def __init__(self, items: list[tuple[int, str]], max_rate: float, recall: float, agreement: float, sampled: int):
        self.ids, self.words, self.limit, self.q, self.need = [], [], [], [], []
        self.walks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sampled, self.reps = sampled, repetitions(recall, agreement, sampled)
        grams: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in items:
            data = plain_bytes(np.frombuffer((text or "").encode(), np.uint8))
            low, a, b, _ = shared.words(data, np.array([0, len(data)]), lower=False)
            if not len(a):
                continue
            word, m = shared.span_hashes(low, a, b), len(a)
            edits = int(max_rate * m)
            q = min(3, -(-(m - edits) // (edits + 1)))
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(word)
            self.limit.append(edits)
            self.q.append(q)
            self.need.append(max(1, m - q + 1 - q * edits))
            for at, g in enumerate(gram_hashes(word, q).tolist()):
                grams[q].append((g, k, at))
        self.grams = {}
        for q, rows in grams.items():
            rows.sort()
            g = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(g >> np.uint64(44)).astype(np.int64)] = True
            self.grams[q] = (g, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), seen)
        self.tables: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for k, word in enumerate(self.words):
            for rep, key in enumerate(self.keys(word[None, :])[0].tolist()):
                self.tables[len(word), rep, key].append(k)

    def walk(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """For windows of ``m`` words: each step's and repetition's salt, and which steps a repetition samples."""
        if m not in self.walks:
            rng, steps = np.random.default_rng(m), 3 * m
            salts = rng.integers(1, 2**63, (steps, self.reps), dtype=np.uint64) | np.uint64(1)
            taken = np.zeros((steps, self.reps), bool)
            for rep in range(self.reps):
                taken[rng.choice(steps, self.sampled, replace=False), rep] = True
            self.walks[m] = salts, taken
        return self.walks[m]

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """The bucket key of each window (a row of word hashes, all of one length) in each repetition; all walk in step."""
        n, m = windows.shape
        salts, taken = self.walk(m)
        padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
        base = (np.arange(n) * (m + 1))[:, None]
        flat, at, out = padded.reshape(-1), np.zeros((n, self.reps), np.int64), np.zeros((n, self.reps), np.uint64)
        for j in range(3 * m):
            symbol = flat[base + at]
            if taken[j].any():
                out = np.where(taken[j], shared.mix(out + symbol), out)
            at = np.minimum(at + ((symbol * salts[j]) >> np.uint64(63)).astype(np.int64), m)
        return out

    def windows(self, word: np.ndarray):
        """Starts of item-sized windows of one text that pass the q-gram lemma, by window length."""
        found: dict[int, set[int]] = defaultdict(set)
        hits = []
        for q, (g, item, offset, seen) in self.grams.items():
            keys = gram_hashes(word, q)
            at = np.flatnonzero(seen[(keys >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(g, keys[at], "left"), np.searchsorted(g, keys[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hits.append(np.stack([item[rows], np.repeat(at, n) - offset[rows], offset[rows]], axis=1))
        hits = np.concatenate(hits) if hits else np.zeros((0, 3), np.int64)
        if not len(hits):
            return found
        hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
        items, first = np.unique(hits[:, 0], return_index=True)
        for k, a, b in zip(items.tolist(), first.tolist(), [*first[1:].tolist(), len(hits)], strict=True):
            if b - a < self.need[k]:
                continue
            diagonal, m, slack = hits[a:b, 1], len(self.words[k]), self.limit[k]
            # hits on the diagonals d - 2 slack .. d belong to one alignment at most
            upto = np.arange(1, b - a + 1) - np.searchsorted(diagonal, diagonal - 2 * slack, "left")
            for end in np.flatnonzero(upto >= self.need[k]).tolist():
                found[m].update(diagonal[end + 1 - upto[end] : end + 1].tolist())
        return found

    def matches(self, word: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(item, first word, word after the last, distance)`` of passages within the limit; those of one item do not overlap."""
        candidates: set[tuple[int, int]] = set()
        for m, starts in self.windows(word).items():
            starts = np.unique(np.clip(np.array(sorted(starts)), 0, max(len(word) - m, 0)))
            rows = starts[:, None] + np.arange(m)[None, :]
            text = np.where(rows < len(word), word[np.minimum(rows, len(word) - 1)], np.uint64(0))
            for start, keys in zip(starts.tolist(), self.keys(text).tolist(), strict=True):
                candidates.update((k, start) for rep, key in enumerate(keys) for k in self.tables.get((m, rep, key), ()))
        out: list[tuple[int, int, int, int]] = []
        runs: list[list[int]] = []
        for k, start in sorted(candidates):
            # starts close together are one piece of text to verify
            if runs and runs[-1][0] == k and start - runs[-1][2] <= self.limit[k]:
                runs[-1][2] = start
            else:
                runs.append([k, start, start])
        for k, first, last in runs:
            m, slack = len(self.words[k]), self.limit[k]
            todo = [(max(0, first - slack), min(len(word), last + m + slack))]
            while todo:
                a, b = todo.pop()
                if b - a < m - slack:
                    continue
                d, lo, hi = align(self.words[k], word[a:b])
                if d <= slack:
                    out.append((k, a + lo, a + hi, d))
                    todo += [(a, a + lo), (a + hi, b)]
        return out


def gram_hashes(word: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(word) - q + 1)
    out = np.zeros(n, np.uint64)
    for j in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word[j : j + n]
    return shared.mix(out)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Edit distance of ``item`` to the nearest part of ``text``, and that part."""
    n = len(text)
    cost, origin = [0] * (n + 1), list(range(n + 1))
    values = text.tolist()
    for i, symbol in enumerate(item.tolist(), 1):
        above, above_origin = cost, origin
        cost, origin = [i] + [0] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            c, o = above[j - 1] + (values[j - 1] != symbol), above_origin[j - 1]
            if above[j] + 1 < c:
                c, o = above[j] + 1, above_origin[j]
            if cost[j - 1] + 1 < c:
                c, o = cost[j - 1] + 1, origin[j - 1]
            cost[j], origin[j] = c, o
    end = min(range(n + 1), key=lambda j: (cost[j], j))
    return cost[end], origin[end], end


def _texts(batch, column: str):
    """Each row's word hashes, and a function from its word numbers to code points."""
    data, offsets = shared.text_buffer(batch.column(column))
    for a, b in shared.row_groups(offsets):
        part = offsets[a : b + 1]
        raw = data[part[0] : part[-1]]
        low, starts, stops, first = shared.words(plain_bytes(raw), part - part[0], lower=False)
        word = shared.span_hashes(low, starts, stops)
        for k in range(a, b):
            lo, hi = int(first[k - a]), int(first[k - a + 1])

            def points(x: int, y: int, lo=lo, base=int(part[k - a] - part[0])) -> tuple[int, int]:
                begin = int(np.count_nonzero((raw[base : starts[lo + x]] & 0xC0) != 0x80))
                return begin, begin + int(np.count_nonzero((raw[starts[lo + x] : stops[lo + y - 1]] & 0xC0) != 0x80))

            yield k, word[lo:hi], points


def item_blocks(benchmark: DataFrame, size: int = ITEM_BLOCK):
    """The benchmark in blocks of at most ``size`` items, each small enough to send to every task."""
    block = []
    for row in benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


OPTIONS = {"max_rate": 0.2, "recall": 0.99, "agreement": 0.4, "sampled": 2}


def find_passages(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each passage of a document within ``max_rate`` word edits of a benchmark item.

    start and end are code points, distance counts words inserted, dropped or changed. Case (of ASCII
    and Latin-1 letters) and ASCII marks are ignored. A null or empty text or item matches nothing; equal items each match; repeated rows
    and rows without doc_id come back each; extra columns are ignored.
    """
    spark, settings = docs.sparkSession, OPTIONS | options
    shared.small_batches(spark)
    slim = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    found = None
    for block in item_blocks(benchmark):

        def task(batches, block=block):
            items = Items(block, **settings)
            for batch in batches:
                ids, rows = batch.column("doc_id").to_pylist(), []
                for k, word, points in _texts(batch, "text"):
                    rows += [(ids[k], items.ids[i], *points(a, b), d, len(items.words[i])) for i, a, b, d in items.matches(word)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        part = slim.mapInArrow(task, SCHEMA)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any such passage, all columns as they were. Nothing is shuffled."""
    settings = OPTIONS | options
    shared.small_batches(docs.sparkSession)
    for block in item_blocks(benchmark):

        def task(batches, block=block):
            items = Items(block, **settings)
            for batch in batches:
                yield batch.filter(pa.array([not items.matches(word) for _, word, _ in _texts(batch, "text")], pa.bool_()))

        docs = docs.mapInArrow(task, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
