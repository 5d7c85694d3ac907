"""Token ids as grammar-compressed shards (Re-Pair).

A shard is a run of documents in doc_id order. Pairs of neighbouring ids that are frequent in the
shard become rules; a rule's two sides may be ids or earlier rules. Pairs are replaced in rounds, the
most frequent of a round at once, left to right where two overlap. No rule crosses a document's
end, so each document starts at a symbol of its own, and the rules' expansion lengths tell where any
of its tokens stands without decoding what comes before.

File format: Parquet files, one row for each shard, with these columns. ``terminals`` (ids below it are
tokens, the others rule ``s - terminals``), ``rules`` (pairs of unsigned 32-bit symbols), ``lengths``
(unsigned 32-bit expansion length of each rule), ``width`` (bytes of a symbol: 2 or 4), ``symbols``
(the shard's sequence), ``doc_ids`` (a list), ``doc_symbols`` (unsigned 64-bit: symbols before each
document), ``doc_tokens`` (unsigned 32-bit: tokens of each document), and ``part``, ``shard``,
``n_tokens`` for their order. All numbers are little-endian.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import encoded, encoder, public_vocabulary

FILE_SCHEMA = (
    "part int, shard int, n_tokens long, terminals long, rules binary, lengths binary, width int, symbols binary, "
    "doc_ids array<long>, doc_symbols binary, doc_tokens binary"
)


def compress(ids: np.ndarray, end_id: int, terminals: int, a_round: int = 3000, least: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The symbol sequence of ``ids`` and its rules (n, 2), in rounds of ``a_round`` rules until no pair is left that occurs ``least`` times."""
    seq, rules, following = ids.astype(np.int64), [], terminals
    while len(seq) > 1:
        free = seq != end_id
        code = seq[:-1] << 32 | seq[1:]
        code[~(free[:-1] & free[1:])] = -1
        # a count by hash bounds a pair's count from above: pairs in thinner bins are not frequent
        slot = (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        thick = np.bincount(slot, minlength=1 << 20)
        pairs, counts = np.unique(code[(thick >= least)[slot] & (code >= 0)], return_counts=True)
        pairs, counts = pairs[counts >= least], counts[counts >= least]
        if not len(pairs):
            break
        chosen = np.sort(pairs[np.lexsort((pairs, -counts))[:a_round]])
        wanted = np.zeros(1 << 20, bool)
        wanted[(chosen.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)] = True
        at = np.flatnonzero(wanted[slot])
        rule = np.minimum(np.searchsorted(chosen, code[at]), len(chosen) - 1)
        hit = chosen[rule] == code[at]
        at, rule = at[hit], rule[hit]
        # of a run of overlapping pairs every other one is taken, from the left
        run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate([run, [len(at)]])))
        at, rule = at[place % 2 == 0], rule[place % 2 == 0]
        used, index = np.unique(rule, return_inverse=True)
        seq[at] = following + index
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([chosen[used] >> 32, chosen[used] & 0xFFFFFFFF], axis=1))
        following += len(used)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    out = [0] * len(rules)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (1 if a < terminals else out[a - terminals]) + (1 if b < terminals else out[b - terminals])
    return np.array(out, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that a run of symbols stands for: each rule is written out once, then all are copied together."""
    begins = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    flat = np.empty(int(begins[-1]), np.uint32)
    starts, stops = begins[:-1].tolist(), begins[1:].tolist()
    for k, sides in enumerate(rules.tolist()):
        at = starts[k]
        for s in sides:
            if s < terminals:
                flat[at] = s
                at += 1
            else:
                a, b = starts[s - terminals], stops[s - terminals]
                flat[at : at + b - a] = flat[a:b]
                at += b - a
    symbols = symbols.astype(np.int64)
    is_rule = symbols >= terminals
    n = np.ones(len(symbols), np.int64)
    n[is_rule] = lengths[symbols[is_rule] - terminals]
    offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(offsets[-1]), np.uint32)
    out[offsets[:-1][~is_rule]] = symbols[~is_rule]
    of_rule = symbols[is_rule] - terminals
    m = n[is_rule]
    inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    out[np.repeat(offsets[:-1][is_rule], m) + inner] = flat[np.repeat(begins[of_rule], m) + inner]
    return out


def encode_shards(docs: DataFrame, vocabulary: str, end_id: int = 1, shard_tokens: int = 1_000_000) -> DataFrame:
    """Rows of FILE_SCHEMA: documents in ascending doc_id order (rows without one first), tokenised and compressed.

    A null text is an empty one: its document is the end id alone. Repeated rows are encoded each.
    A shard closes at ``shard_tokens`` ids; a longer document is a shard of its own.
    """
    shared.small_batches(docs.sparkSession)

    def task(batches):
        from pyspark import TaskContext

        enc, end = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        terminals = enc.tokenizer.get_vocab_size()
        part, shard, names, held, tokens = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            seq, rules = compress(ids, end_id, terminals)
            lengths = rule_lengths(rules, terminals)
            ends = np.flatnonzero(seq == end_id)
            ends = ends[_true_ends(seq, ends, lengths, terminals, held)]
            width = 2 if terminals + len(rules) <= 65536 else 4
            values = [part, shard, len(ids), terminals, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), width, seq.astype(f"<u{width}").tobytes(), names]
            values += [np.concatenate([[0], ends[:-1] + 1]).astype("<u8").tobytes(), np.array([len(h) // 4 for h in held], "<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, ARROW, strict=True)], names=COLUMNS)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded(enc, batch.column("text")), strict=True):
                if held and tokens + len(ids) // 4 + 1 > shard_tokens:
                    yield close()
                    shard, names, held, tokens = shard + 1, [], [], 0
                names.append(doc_id)
                held.append(ids + end)
                tokens += len(held[-1]) // 4
        if held:
            yield close()

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(task, FILE_SCHEMA)


def _true_ends(seq: np.ndarray, ends: np.ndarray, lengths: np.ndarray, terminals: int, held: list[bytes]) -> np.ndarray:
    """Which symbols with the end's id close a document: text may hold that id too, so token counts decide."""
    n = np.ones(len(seq), np.int64)
    is_rule = seq >= terminals
    n[is_rule] = lengths[seq[is_rule] - terminals]
    upto = np.cumsum(n)[ends]
    return np.searchsorted(upto, np.cumsum([len(h) // 4 for h in held]))


COLUMNS = [c.strip().split()[0] for c in FILE_SCHEMA.split(", ")]
ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def document_ids(shard: dict, k: int) -> np.ndarray:
    """Random access: the ids of document ``k`` of a shard row, from its own symbols only."""
    symbols = np.frombuffer(shard["symbols"], f"<u{shard['width']}")
    begins = np.frombuffer(shard["doc_symbols"], "<u8").tolist() + [len(symbols)]
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    return expand(symbols[begins[k] : begins[k + 1]], rules, np.frombuffer(shard["lengths"], "<u4"), shard["terminals"])


def decoded(files: DataFrame) -> DataFrame:
    """``(part, shard, place, doc_id, before, n_tokens, ids_crc32)`` for each document of the shard files; ``before`` counts ids inside the shard."""
    shared.small_batches(files.sparkSession, 4)

    def task(batches):
        for batch in batches:
            for s in batch.to_pylist():
                symbols = np.frombuffer(s["symbols"], f"<u{s['width']}")
                ids = expand(symbols, np.frombuffer(s["rules"], "<u4").reshape(-1, 2), np.frombuffer(s["lengths"], "<u4"), s["terminals"])
                counts = np.frombuffer(s["doc_tokens"], "<u4").astype(np.int64)
                begins, n = np.cumsum(counts) - counts, len(counts)
                crc = [zlib.crc32(ids[b : b + c].tobytes()) for b, c in zip(begins.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["part"]] * n, pa.int32()), pa.array([s["shard"]] * n, pa.int32()), pa.array(s["doc_ids"], pa.int64()), pa.array(begins), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(task, "part int, shard int, doc_id long, before long, n_tokens long, ids_crc32 long")


def write_corpus(docs: DataFrame, path: str, vocabulary: str, **options) -> None:
    encode_shards(docs, vocabulary, **options).write.option("compression", "zstd").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files at ``path`` with ``start``, the ids of all documents before it.

    Shards are summed inside their part first, so that the one ordered pass over all of them has a
    row for each part (a task of the writing job), not for each shard.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    shards = files.select("part", "shard", "n_tokens")
    inside = shards.withColumn("in_part", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens"))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    offsets = inside.join(base, "part").select("part", "shard", (F.col("base") + F.col("in_part")).alias("offset"))
    return decoded(files).join(offsets, ["part", "shard"]).select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op5_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.scratch_path(spark, "grammar")
    write_corpus(shared.table(spark, sf_dir, "documents"), path, public_vocabulary())
    return read_corpus(spark, path)
