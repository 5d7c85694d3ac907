"""Pattern packing by non-negative least squares: the histogram of lengths decides, not the single document.

Documents are cut only where they exceed a sequence, the short piece first. The histogram of piece lengths has one
entry a length, so the whole plan is made from at most ``size`` numbers whatever the corpus holds: patterns of up
to three lengths that fill a sequence exactly are enumerated, repeat counts are fitted to the histogram by
non-negative least squares, rounded, and what is left is packed by best fit on the histogram itself, whole runs of equal
lengths at a time. A piece finds its place by its rank among the pieces of its length: its rank within its task
plus the number of such pieces in the tasks before it, so no length is ever sorted in one place.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import ByteEncoder, encoded, encoder, public_vocabulary

SIZE = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
ROUNDS, JOINING, TOLERANCE = 30, 256, 0.01
#: Which parts of the fitted repeats are tried as whole repeats; the rest is packed by best fit.
PARTS = (1.0, 0.95, 0.8, 0.5)


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Every piece with its task and its place among the pieces of its length there; with ``keep_ids`` its ids too (little-endian, unsigned, 32 bits)."""
    schema = PIECES + (", ids binary" if keep_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches):
        from pyspark import TaskContext

        enc, end, part = encoder(vocabulary, ByteEncoder), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        rows: list[tuple] = []

        def batch_of(rows):
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds)], names=names)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded(enc, batch.column("text")), strict=True):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n, size), n] if n > size else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(own), part, seen[b - a], *((own.tobytes(),) if keep_ids else ())))
                    seen[b - a] += 1
                if len(rows) >= (2_000 if keep_ids else 20_000):
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(task, schema)


def exact_patterns(counts: np.ndarray) -> np.ndarray:
    """All ways to fill a sequence with one, two or three lengths that occur, as rows of three lengths in descending order (0: none)."""
    size = len(counts) - 1
    a, b = np.meshgrid(np.arange(1, size + 1), np.arange(0, size + 1), indexing="ij")
    c = size - a - b
    found = np.stack([a, b, c], axis=-1)[(a >= b) & (b >= c) & (c >= 0)]
    there = counts > 0
    there[0] = True
    return found[there[found].all(axis=1)]


def fitted(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 with least weighted squares of ``A x - counts`` (A: how often each pattern has each length).

    An active-set method: patterns of the steepest descent that share no length join the set together, the set is solved
    without constraint, and patterns that come out negative leave until none does. The best of the rounds stays. Long pieces
    weigh more, as short ones fill gaps anywhere.
    """
    size = len(counts) - 1
    weight = 0.1 + np.arange(size + 1) / size
    weight[0] = 0.0
    goal, x = weight * counts, np.zeros(len(patterns))
    taken, best, least = np.zeros(0, np.int64), x, np.inf
    for _ in range(ROUNDS):
        miss = goal - weight * np.bincount(patterns.ravel(), np.repeat(x, 3), size + 1)
        if (off := float(miss @ miss)) < least:
            settled, best, least = off > least * (1 - TOLERANCE), x.copy(), off
            if settled:
                break
        slope = (weight * miss)[patterns].sum(axis=1)
        slope[taken] = 0.0
        used, fresh = set(), []
        for j in np.argsort(-slope)[: 16 * JOINING].tolist():
            lengths = set(patterns[j].tolist()) - {0}
            if slope[j] > 0 and not used & lengths:
                fresh.append(j)
                used |= lengths
        if not fresh:
            break
        taken = np.concatenate([taken, fresh]).astype(np.int64)
        while len(taken):
            matrix = np.zeros((size + 1, len(taken)))
            for k in range(3):
                np.add.at(matrix, (patterns[taken, k], np.arange(len(taken))), weight[patterns[taken, k]])
            square = matrix.T @ matrix
            solved = np.linalg.solve(square + 1e-9 * np.eye(len(taken)), matrix.T @ goal)
            x[:] = 0.0
            if (solved > 0).all():
                x[taken] = solved
                break
            taken = taken[solved > 0]
    return best


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: ``(lengths, repeats)``. Runs of equal lengths go into runs of equal sequences at a time."""
    size = len(counts) - 1
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    for length in range(size, 0, -1):
        left, at = int(counts[length]), length
        while left:
            while at <= size and not room[at]:
                at += 1
            if at > size:
                fit = size // length
                for number, repeats in ((fit, left // fit), (left % fit, 1)):
                    if number and repeats:
                        room[size - number * length].append(((length,) * number, repeats))
                break
            lengths, repeats = room[at].pop()
            now = min(left, repeats)
            if repeats > now:
                room[at].append((lengths, repeats - now))
            room[at - length].append(((*lengths, length), now))
            left -= now
            # what was just filled may have room for one more and is the tightest then
            at = min(at, at - length) if at - length >= length else at
    return [x for some in room for x in some]


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)`` that use every piece of the histogram (``counts[n]`` pieces of length n) exactly once."""
    patterns = exact_patterns(counts)
    if not len(patterns):
        return best_fit(counts)
    x = fitted(patterns, counts.astype(float))
    return min((_rounded(patterns, x * part, counts) for part in PARTS), key=lambda tried: sum(repeats for _, repeats in tried))


def _rounded(patterns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats, the most frequent patterns first, as far as the pieces last; then best fit for the rest."""
    left, found = counts.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable").tolist():
        if x[j] < 0.5:
            break
        need = Counter(n for n in patterns[j].tolist() if n)
        repeats = min(int(x[j] + 0.5), *(int(left[n]) // k for n, k in need.items()))
        if repeats > 0:
            found.append((tuple(sorted(need.elements(), reverse=True)), repeats))
            for n, k in need.items():
                left[n] -= k * repeats
    return found + best_fit(left)


def slots(planned: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, ...]:
    """Sorted arrays (length, first rank, first sequence, offset): pieces of a length from that rank on lie in sequences from that one on, at that offset."""
    used, rows, sequence = np.zeros(size + 1, np.int64), [], 0
    for lengths, repeats in planned:
        offset = 0
        for n in lengths:
            rows.append((n, int(used[n]), sequence, offset))
            used[n] += repeats
            offset += n
        sequence += repeats
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def pack_patterns(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: where it stands in its document and in its sequence.

    A null text is an empty one (its document is the end id alone); a null doc_id stays null; repeated rows are packed each;
    an empty table gives no rows; extra columns are ignored; a very long text gives one short piece and full ones.
    Pieces of one length are equal to the plan, so ties need no rule: they go by task and place.
    """
    spark = docs.sparkSession
    cut = shared.saved(pieces(docs, vocabulary, size, end_id, keep_ids), "pieces")
    by_task = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["length"]] = row["n"]
    length, first, sequence, offset = slots(plan(counts), size)
    # one number orders lengths and ranks: a rank is below the number of pieces
    wide = int(counts.max()) + 1
    key = length * wide + first
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.join(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), ["part", "length"])
    schema = PLACED + (", ids binary" if keep_ids else "")

    def task(batches):
        for batch in batches:
            n, rank = np.asarray(batch.column("length")), np.asarray(batch.column("place")) + np.asarray(batch.column("before"))
            at = np.searchsorted(key, n * wide + rank, "right") - 1
            place = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([*own, *place, *([batch.column("ids")] if keep_ids else [])], names=names)

    return ranked.mapInArrow(task, schema)


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_patterns(shared.table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))
