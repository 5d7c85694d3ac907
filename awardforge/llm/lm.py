"""Language-model scoring by a weighted backoff automaton.

States are the contexts seen in training: ``order - 1`` words at most, the root is the empty one, and a
document begins in a state of its own. A state has an arc for each word seen after it, to the longest
suffix of the words so far that is a state, and a failure arc to the context shortened by one word. For a
state h with c(h) visits the arc of w weighs ``log10((1 - b) c(hw) / c(h) + b p(w | shorter h))`` and the
failure arc ``log10 b``; b is the share of novel words after contexts of that length and frequency (by
powers of two), estimated over all training tokens by leaving each out in turn. At the root a known word
weighs ``(c - D) / N`` and all unknown words together ``D V / N``.

The automaton grows with the corpus, so it is never gathered whole. Documents are cut into chunks; each
chunk asks for the grams that its own texts hold (sorted 64-bit keys, packed), their counts are summed by
key range, and the sums go back to the chunks. From them a chunk builds the part of the automaton that its
texts can reach: states, arcs and failure arcs as arrays. Each document is then read from left to right
once: where the state has no arc for the word its failure arc is taken, and weights add up on the way.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

END, START = np.uint64(0x5E17D3A9C24F8B01), np.uint64(0x1B873593CC9E2D51)
ROOT, BEGIN = 0, 1
BANDS = 40
CHUNK_BYTES = 3_500_000
#: Text bytes a key range answers for: about 4 million keys.
RANGE_BYTES = 16_000_000
#: A corpus has fewer distinct grams than bytes; with that many bits more than the number of bytes has, a gram
#: shares its key with another with a chance of 2^-20 at every size.
SPARE_BITS = 20


def packed(x: np.ndarray) -> bytes:
    """Numbers as zstd over byte planes, so that leading zero bytes cost nothing."""
    x = np.ascontiguousarray(x)
    return len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=n * width + 1), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def held_out(doc_id: int | None, parts: int = 10) -> bool:
    """A row without an id counts as one with an empty id."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts == 0


class Chunk:
    """Some whole documents: their ids and joined text bytes."""

    def __init__(self, ids: list, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.data, self.offsets = ids, data, offsets
        self.train = np.array([not held_out(d) for d in ids], bool)

    @classmethod
    def read(cls, row: dict) -> Chunk:
        offsets = unpacked(row["offsets"], "<i8")
        data = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=int(offsets[-1]) + 1)
        return cls(row["ids"], np.frombuffer(data, np.uint8), offsets)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash of each token (a document ends in ``END``), the first token of each document and every token's place in its own."""
        tokens, firsts, at = [], [], 0
        for a, b in shared.row_groups(self.offsets):
            part = self.offsets[a : b + 1]
            low, starts, stops, first = shared.words(self.data[part[0] : part[-1]], part - part[0])
            n = len(starts)
            with_ends = np.full(n + b - a, END)
            place = np.arange(n) + np.repeat(np.arange(b - a), np.diff(first))
            with_ends[place] = shared.span_hashes(low, starts, stops)
            tokens.append(with_ends)
            firsts.append(at + first[:-1] + np.arange(b - a))
            at += len(with_ends)
        word, first = np.concatenate(tokens), np.concatenate(firsts)
        return word, first, np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))

    def grams(self, order: int, bits: int = 64):
        """``(k, positions, keys)`` for k = 1..order: the k-gram that ends at each position, the document's start being one of its words.

        A key of a single word has 64 bits, longer ones the first ``bits`` of them.
        """
        word, first, place = self.words
        key = word
        for k in range(1, order + 1):
            if k > 1:
                context = np.empty_like(word)
                context[1:] = key[:-1]
                context[first] = START
                key = shared.mix(context * np.uint64(0x9E3779B97F4A7C15) + word)
            at = np.flatnonzero(place >= k - 2)
            yield k, at, key[at] >> np.uint64(0 if k == 1 else 64 - bits)

    def trained(self) -> np.ndarray:
        """Whether each token is a training token."""
        word, first, _ = self.words
        return np.repeat(self.train, np.diff(np.append(first, len(word))))


def chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """``chunk, ids, text, offsets, size``: whole documents, joined until they have ``chunk_bytes``."""
    shared.small_batches(docs.sparkSession)

    def task(batches):
        from pyspark import TaskContext

        z, number, ids, parts, held = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32, [], [], 0

        def row():
            data = np.concatenate([p[0] for p in parts])
            bases = np.cumsum([0, *[len(p[0]) for p in parts[:-1]]])
            offsets = np.concatenate([[0], *[p[1][1:] + base for p, base in zip(parts, bases, strict=True)]])
            columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([z.compress(data.tobytes())], pa.binary()), pa.array([packed(offsets.astype("<i8"))], pa.binary()), pa.array([len(data)])]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "text", "offsets", "size"])

        for batch in batches:
            parts.append(shared.text_buffer(batch.column("text")))
            ids.extend(batch.column("doc_id").to_pylist())
            held += len(parts[-1][0])
            if held >= chunk_bytes:
                yield row()
                number, ids, parts, held = number + 1, [], [], 0
        if ids:
            yield row()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(task, "chunk long, ids array<long>, text binary, offsets binary, size long")


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and for every key the number of its distinct one."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(keys)]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return ordered[fresh], order[fresh], inverse


def _ask(order: int, ranges: int, bits: int):
    """A chunk's distinct keys and their training counts, cut into key ranges."""
    edges = (np.arange(1, ranges, dtype=object) * 2**64 // ranges).astype(np.uint64)
    kinds = dict(r=pa.int32(), chunk=pa.int64(), k=pa.int32(), keys=pa.binary(), counts=pa.binary())

    def asked(number: int, chunk: Chunk):
        train = chunk.trained()
        for k, at, keys in chunk.grams(order, bits):
            distinct, _, inverse = grouped(keys)
            counts = np.bincount(inverse[train[at]], minlength=len(distinct)).astype(np.uint32)
            cuts = np.concatenate([[0], np.searchsorted(distinct, edges >> np.uint64(0 if k == 1 else 64 - bits)), [len(distinct)]]).tolist()
            for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    yield r, number, k, packed(np.diff(distinct[a:b], prepend=np.uint64(0))), packed(counts[a:b])

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(asked(row["chunk"], Chunk.read(row)))
                for at in range(0, len(rows), 64):
                    columns = zip(*rows[at : at + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return task


def _answer(group: pa.Table) -> pa.Table:
    """Total counts over one key range, to each chunk in the order it asked; chunk -1 has the range's own sums."""
    out, r = [], group.column("r")[0].as_py()
    for k in sorted(set(group.column("k").to_pylist())):
        part = group.filter(pc.equal(group.column("k"), k))
        keys = [np.cumsum(unpacked(b.as_py(), "<u8")) for b in part.column("keys")]
        counts = np.concatenate([unpacked(b.as_py(), "<u4") for b in part.column("counts")])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.uint64)
        replies, at = total[inverse], 0
        for number, own in zip(part.column("chunk").to_pylist(), keys, strict=True):
            out.append((number, k, r, packed(replies[at : at + len(own)])))
            at += len(own)
        if k == 1:
            sums = [total.sum(), np.count_nonzero(total), np.count_nonzero(total == 1), np.count_nonzero(total == 2), total[distinct == END].sum()]
            out.append((-1, k, r, np.array(sums, "<u8").tobytes()))
    kinds = dict(chunk=pa.int64(), k=pa.int32(), r=pa.int32(), counts=pa.binary())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _band(visits: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(visits, 1).astype(np.float64)).astype(np.int64), BANDS - 1)


#: The arrays of a chunk's automaton; arcs are listed by the length of their gram, so an arc's suffix stands before it.
PARTS = ("words", "arc_state", "arc_word", "arc_count", "arc_suffix", "arc_target", "visits", "fail", "length")


def novel_tokens(chunk: Chunk, order: int, totals: dict[int, np.ndarray], documents: int, bits: int = 64) -> np.ndarray:
    """The chunk's training tokens by length and band of their context, and how many of them are novel there.

    The visits of a context are the count of the gram that ends one token before, those of a document's start the number of documents.
    """
    novel = np.zeros((order + 1, BANDS, 2), np.int64)
    train, (word, first, _) = chunk.trained(), chunk.words
    visits = np.zeros(len(word), np.int64)
    for k, at, keys in chunk.grams(order, bits):
        count = np.zeros(len(word), np.int64)
        count[at] = totals[k].astype(np.int64)[grouped(keys)[2]]
        if k > 1:
            left = at[train[at] & (visits[at] > 1)]
            band = _band(visits[left] - 1)
            novel[k] = np.stack([np.bincount(band, minlength=BANDS), np.bincount(band[count[left] == 1], minlength=BANDS)], axis=1)
        visits[1:] = count[:-1]
        visits[first] = documents
    return novel


def automaton(chunk: Chunk, order: int, totals: dict[int, np.ndarray], training: int, documents: int, bits: int = 64) -> dict[str, np.ndarray]:
    """States, arcs and failure arcs that the chunk's texts can reach.

    ``totals[k]`` are the training counts of the chunk's distinct k-grams in key order.
    """
    parts = {name: [] for name in PARTS}
    parts["visits"], parts["fail"], parts["length"] = [[training, documents]], [[ROOT, ROOT]], [[0, 1]]
    states, arcs = 2, 0
    word, first, _ = chunk.words
    # the arc of the gram one shorter that ends at each token and the state it leads to, -1 where there is none; at first of the empty gram
    arc, reached = np.full(len(word), -1), np.full(len(word), ROOT)
    for k, at, keys in chunk.grams(order, bits):
        distinct, index, inverse = grouped(keys)
        count, where = totals[k].astype(np.int64), at[index]
        if len(count) != len(distinct):
            raise RuntimeError("a chunk got other counts than it asked for")
        if k == 1:
            # every word of the texts has an arc at the root, the unknown ones too
            parts["words"], known, context = [inverse], np.ones(len(distinct), bool), np.full(len(distinct), ROOT)
        else:
            before = np.concatenate([[BEGIN], reached[:-1]])
            before[first] = BEGIN
            context = before[where]
            known = (count > 0) & (context >= 0) & (arc[where] >= 0)
        shorter, ends = reached[where], word[where] == END
        new = known & (count > 0) & ~ends if k < order else np.zeros(len(distinct), bool)
        n_new = int(np.count_nonzero(new))
        state = np.full(len(distinct), -1)
        state[new] = states + np.arange(n_new)
        target = np.where(ends | ~(count > 0), ROOT, state if k < order else shorter)
        number = np.where(known, arcs + np.cumsum(known) - 1, -1)
        for name, x in (("visits", count[new]), ("fail", shorter[new]), ("length", np.full(n_new, k))):
            parts[name].append(x)
        for name, x in (("arc_state", context), ("arc_word", parts["words"][0][where]), ("arc_count", count), ("arc_suffix", arc[where]), ("arc_target", target)):
            parts[name].append(x[known])
        states, arcs = states + n_new, arcs + int(np.count_nonzero(known))
        arc, reached = np.full(len(word), -1), np.full(len(word), -1)
        arc[at], reached[at] = number[inverse], state[inverse]
    return {name: np.concatenate(parts.pop(name)).astype(np.int64, copy=False) for name in PARTS}


def _assemble(order: int, documents: int, bits: int):
    """A chunk's texts joined by the counts sent back to it, and its novel tokens."""

    def join(key, texts: pa.Table, replies: pa.Table) -> pa.Table:
        rows, told = [], sorted(replies.select(["k", "r", "counts"]).to_pylist(), key=lambda x: x["r"])
        for t in texts.to_pylist():
            totals = {k: np.concatenate([unpacked(x["counts"], "<u8") for x in told if x["k"] == k] or [np.zeros(0, np.uint64)]) for k in range(1, order + 1)}
            novel = novel_tokens(Chunk.read(t), order, totals, documents, bits)
            rows.append((t["ids"], t["text"], t["offsets"], [packed(totals[k]) for k in range(1, order + 1)], novel[2:].reshape(-1).tolist()))
        names = ["ids", "text", "offsets", "totals", "novel"]
        kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names=names)

    return join, "ids array<long>, text binary, offsets binary, totals array<binary>, novel array<long>"


def weigh(parts: dict[str, np.ndarray], back: np.ndarray, discount: float, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each arc and of each state's failure arc."""
    training, count, visits = int(parts["visits"][ROOT]), parts["arc_count"].astype(np.float64), parts["visits"].astype(np.float64)
    length = parts["length"]
    fail = np.where(length > 0, back[np.minimum(length + 1, len(back) - 1), _band(visits)], 1.0)
    p = np.empty(len(count))
    of = length[parts["arc_state"]]
    for k in range(int(of.max(initial=0)) + 1):
        at = np.flatnonzero(of == k)
        state = parts["arc_state"][at]
        if k == 0:
            p[at] = np.where(count[at] > 0, count[at] - discount, discount * vocabulary) / training if training else 1.0
        else:
            p[at] = (1 - fail[state]) * count[at] / visits[state] + fail[state] * p[parts["arc_suffix"][at]]
    return np.log10(p), np.log10(fail)


def arc_order(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Arcs by state and word, as one number each: a state has one arc for a word, and both are numbers below 2^31."""
    return np.argsort(state << 32 | word)


def traverse(words: list[int], low: array, arc_word: array, weight: array, target: array, cost: array, fail: array) -> float:
    """The log-probability of one document: a walk from ``BEGIN``, taking failure arcs until the state has an arc for the word.

    The arcs of a state stand together in the order of their words; the root has one for each word.
    """
    state, total = BEGIN, 0.0
    for word in words:
        while state:
            arc, end = low[state], low[state + 1]
            if arc < end:
                # most states of more than a word have one arc here
                if arc_word[arc] == word:
                    break
                if end - arc > 1:
                    arc = bisect_left(arc_word, word, arc + 1, end)
                    if arc < end and arc_word[arc] == word:
                        break
            total += cost[state]
            state = fail[state]
        else:
            arc = word
        total += weight[arc]
        state = target[arc]
    return total


def score_documents(docs: DataFrame, order: int = 3, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    A null text is an empty one (the end token alone); a null doc_id counts as held out; repeated rows
    each train and each get a score; an empty table gives no rows; other columns are ignored. A text is
    scored whole; one longer than ``chunk_bytes`` is a chunk of its own, held in one task's memory.
    """
    spark = docs.sparkSession
    texts = shared.saved(chunks(docs, chunk_bytes), "chunks")
    shared.small_batches(spark, 1)
    size = texts.agg(F.sum("size")).first()[0] or 0
    ranges = max(shared.partitions(spark, 4), -(-size // RANGE_BYTES))
    bits = min(64, int(size).bit_length() + SPARE_BITS)
    asked = texts.mapInArrow(_ask(order, ranges, bits), "r int, chunk long, k int, keys binary, counts binary")
    replies = shared.saved(asked.groupBy("r").applyInArrow(_answer, "chunk long, k int, r int, counts binary"), "arcs")
    root = [np.frombuffer(r.counts, "<u8").astype(np.int64) for r in replies.where("chunk = -1").select("counts").collect()]
    training, vocabulary, once, twice, documents = (int(x) for x in np.sum(root, axis=0)) if root else (0, 0, 0, 0, 0)
    join, schema = _assemble(order, documents, bits)
    built = texts.groupBy("chunk").cogroup(replies.where("chunk >= 0").groupBy("chunk")).applyInArrow(join, schema)
    built = shared.saved(built, "automata")
    novel = np.zeros((order + 1, BANDS, 2))
    for pos, total in built.select(F.posexplode("novel")).groupBy("pos").agg(F.sum("col")).collect():
        novel[2:].reshape(-1)[pos] = total
    back = np.clip((novel[:, :, 1] + 1) / (novel[:, :, 0] + 2), 1e-4, 1 - 1e-4)
    discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)

    def column(kind: str, x: np.ndarray) -> array:
        return array(kind, x.astype(kind, copy=False).tobytes())

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.read(row)
                parts = automaton(chunk, order, {k: unpacked(x, "<u8") for k, x in enumerate(row["totals"], 1)}, training, documents, bits)
                weight, cost = weigh(parts, back, discount, vocabulary)
                state = parts.pop("arc_state")
                count = parts.pop("arc_count")[: int(np.count_nonzero(state == ROOT))].astype(np.float64)
                sort = arc_order(state, parts["arc_word"])
                low = np.searchsorted(state[sort], np.arange(len(cost) + 1))
                ids, words, first = chunk.ids, parts.pop("words"), chunk.words[1]
                # each array goes once its table is made, so that a worker holds the automaton little more than once
                tables = [column("q", low), column("I", parts.pop("arc_word")[sort]), column("d", weight[sort]), column("I", parts.pop("arc_target")[sort]), column("d", cost), column("I", parts.pop("fail"))]
                del parts, state, sort, low, weight, cost
                bounds = np.append(first, len(words)).tolist()
                scores = [traverse(words[a:b].tolist(), *tables) for a, b in zip(bounds, bounds[1:], strict=False)]
                base = np.log10((count + 0.1) / (training + 0.1 * (vocabulary + 1)))
                sums = [np.add.reduceat(x[words], first) for x in ((count > 0).astype(np.int64), base)]
                columns = [pa.array(ids, pa.int64()), pa.array([held_out(d) for d in ids]), pa.array(np.diff(bounds)), pa.array(sums[0]), pa.array([training] * len(ids), pa.int64()), pa.array(sums[1]), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return built.mapInArrow(task, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(shared.table(spark, sf_dir, "documents"))
