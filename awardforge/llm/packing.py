"""Packing: documents into training sequences by best-fit decreasing.

Each task tokenises its documents and packs them in windows of bounded size, so nothing is shuffled
and a lost executor's partition is simply packed anew.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared
from .tokens import encoded, encoder, public_vocabulary

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """A segment tree over remaining capacities 0..size: counts of open windows, and the windows of each capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, capacity: int) -> int:
        """Remove and give a window of exactly this capacity."""
        i = capacity + self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.open[capacity].pop()

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` that an open window has, or -1."""
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of piece numbers; every length is 1..size."""
    tree, windows = CapacityTree(size), []
    for piece in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = tree.tightest(lengths[piece])
        if room < 0:
            window, room = len(windows), size
            windows.append([])
        else:
            window = tree.take(room)
        windows[window].append(piece)
        if room > lengths[piece]:
            tree.add(room - lengths[piece], window)
    return windows


def _tail_sizes(total: int, size: int, waste: int) -> list[int]:
    """Sequence sizes for a window that holds ``total`` ids: the window itself if it lacks ``waste`` at most, else powers of two."""
    if total == size or size - total <= waste:
        return [total]
    return [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]


def pack(docs: list[tuple[int | None, np.ndarray]], size: int, first_sequence: int, waste: int) -> tuple[list[tuple], int]:
    """Rows of SCHEMA for one window of documents, and the number of the next sequence."""
    rows, pieces, lengths = [], [], []
    sequence = first_sequence

    def row(doc: int, start: int, length: int, offset: int) -> None:
        doc_id, ids = docs[doc]
        rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), sequence, offset))

    for doc, (_, ids) in enumerate(docs):
        whole = len(ids) // size * size
        for start in range(0, whole, size):
            row(doc, start, size, 0)
            sequence += 1
        if len(ids) > whole:
            pieces.append((doc, whole))
            lengths.append(len(ids) - whole)
    for window in best_fit_decreasing(lengths, size):
        left = [(pieces[p][0], pieces[p][1], lengths[p]) for p in window][::-1]
        for room in _tail_sizes(sum(lengths[p] for p in window), size, waste):
            offset = 0
            while offset < room:
                doc, start, length = left.pop()
                part = min(length, room - offset)
                row(doc, start, part, offset)
                if part < length:
                    left.append((doc, start + part, length - part))
                offset += part
            sequence += 1
    return rows, sequence


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 2, waste: int = 32, window_tokens: int = 4_000_000) -> DataFrame:
    """One row for each piece of a document: where it stands in its document and in its sequence.

    A null text is an empty one (its document is the end id alone); a null doc_id stays null; repeated
    rows are packed each. Extra columns are ignored; an empty table gives no rows. Documents are
    packed in windows of ``window_tokens`` ids, at least one document each.
    """
    shared.small_batches(docs.sparkSession)

    def task(batches):
        from pyspark import TaskContext

        enc, end = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        sequence, held, tokens = TaskContext.get().partitionId() << 40, [], 0

        def flush():
            nonlocal sequence, held, tokens
            rows, sequence = pack(held, size, sequence, waste)
            held, tokens = [], 0
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 50_000], strict=True)], names=NAMES)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded(enc, batch.column("text")), strict=True):
                ids = np.frombuffer(ids + end, dtype="<u4")
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= window_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(task, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(shared.table(spark, sf_dir, "documents"), public_vocabulary())
