"""Repeated passages by sparse suffix arrays.

Only suffixes at minimisers are kept: of every ``window`` consecutive k-word grams the one with the least
hash. A passage of ``least_words = k + window - 1`` words holds such a window whole, so each of its copies
keeps the same suffixes. Suffixes whose gram occurs once are dropped; the rest are sorted by gram and the
words that follow (a range partitioning: one very common passage spreads over many tasks), neighbours are
compared, and each match is extended word by word to both sides. A suffix carries 16-bit marks of the
``window`` words on either side; a longer match goes on past them in the suffix of its next minimiser.

Sorted neighbours are all pairs of a gram with ``max(HOPS) + 1`` suffixes at most. Suffixes of a more common
gram are also grouped by each passage of ``least_words`` words around the gram, as a match that needs
words to its left need not be near in that order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

GRAM, LEAST_WORDS, HOPS = 10, 50, (1, 2, 3)
HOT, SALTS = 2000, 16


def _documents(batch, gram: int):
    """Of each row with words enough: its number in the batch, its word hashes and its gram hashes."""
    data, offsets = shared.text_buffer(batch.column("text"))
    for a, b in shared.row_groups(offsets):
        part = offsets[a : b + 1]
        low, starts, stops, first = shared.words(data[part[0] : part[-1]], part - part[0])
        word = shared.span_hashes(low, starts, stops)
        for k in range(a, b):
            own = word[int(first[k - a]) : int(first[k - a + 1])]
            n = len(own) - gram + 1
            if n > 0:
                code = np.zeros(n, np.uint64)
                for j in range(gram):
                    code = code * np.uint64(0x9E3779B97F4A7C15) + own[j : j + n]
                yield k, own, shared.mix(code)


def minimisers(code: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost least hash of each window, in order."""
    if len(code) < window:
        return np.zeros(0, np.int64)
    out = []
    for at in range(0, len(code) - window + 1, 100_000):
        view = np.lib.stride_tricks.sliding_window_view(code[at : at + 100_000 + window - 1], window)
        out.append(np.unique(view.argmin(axis=1) + np.arange(len(view))) + at)
    return np.unique(np.concatenate(out))


def _candidates(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """``(row, places)``: the word places of each document's minimisers whose gram occurs elsewhere too, and whether it is common there."""

    def task(batches):
        for batch in batches:
            rows, ats, codes = [], [], []
            for k, _, code in _documents(batch, gram):
                at = minimisers(code, window)
                rows.append(np.full(len(at), k))
                ats.append(at)
                codes.append(code[at])
            if rows:
                row = batch.column("row").take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes).view(np.int64)), row, pa.array(np.concatenate(ats).astype(np.int32))], names=["gram", "row", "at"])

    suffixes = docs.select("row", "text").mapInArrow(task, "gram long, row long, at int")
    counts = shared.saved(suffixes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # a gram with a large share of all suffixes would fill one task of the join; there are at most HOT of them, so they go to all tasks
    hot = counts.where(F.col("n") * HOT >= total).select("gram", F.lit(True).alias("hot"))
    cold = counts.where(F.col("n") * HOT < total).select("gram", F.lit(0).alias("part"), (F.col("n") > max(HOPS) + 1).alias("common"))
    spread = suffixes.join(F.broadcast(hot), "gram", "left").withColumn("part", F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("row", "at"), F.lit(4096)).cast("int")).otherwise(0))
    found = spread.join(cold, ["gram", "part"], "left").where("hot or common is not null")
    return found.groupBy("row").agg(F.collect_list(F.struct("at", F.coalesce("common", F.lit(True)).alias("common"))).alias("places"))


def _suffixes(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """The kept suffixes with marks of the words around: ``after`` onwards, ``before`` backwards from the gram."""
    found = docs.select("row", "text").join(_candidates(docs, gram, window), "row")

    def task(batches):
        for batch in batches:
            places, rows = batch.column("places"), batch.column("row").to_pylist()
            for k, word, code in _documents(batch, gram):
                marks = (word >> np.uint64(48)).astype(">u2")
                common = {x["at"]: x["common"] for x in places[k].as_py()}
                at = np.array(sorted(common), np.int64)
                for lo in range(0, len(at), 5000):
                    some = at[lo : lo + 5000]
                    after = [marks[x + gram : x + gram + window].tobytes() for x in some.tolist()]
                    before = [marks[max(0, x - window) : x][::-1].tobytes() for x in some.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(code[some].view(np.int64)), pa.array(after, pa.binary()), pa.array(before, pa.binary()), pa.array([rows[k]] * len(some)), pa.array(some.astype(np.int32)), pa.array([common[x] for x in some.tolist()])],
                        names=["gram", "after", "before", "row", "at", "common"],
                    )

    return found.mapInArrow(task, "gram long, after binary, before binary, row long, at int, common boolean")


def _marks(column, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks as a matrix padded with zeros, and how many each row has."""
    blobs = column.to_pylist()
    n = np.array([len(b) // 2 for b in blobs], np.int64)
    flat = np.frombuffer(b"".join(b.ljust(2 * window, b"\0") for b in blobs), ">u2").reshape(-1, window)
    return flat, n


def _common(a, an, b, bn) -> np.ndarray:
    same = a == b
    run = np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))
    return np.minimum(run, np.minimum(an, bn))


def _matches(table: pa.Table, gram: int, window: int, least: int) -> list[np.ndarray]:
    """``(row, first word, word after the last)`` of both sides of each match between near neighbours of one sorted run."""
    n = table.num_rows
    code = table.column("gram").to_numpy()
    row, at = table.column("row").to_numpy(), table.column("at").to_numpy().astype(np.int64)
    after, before = _marks(table.column("after"), window), _marks(table.column("before"), window)
    here = np.arange(n)
    block = np.maximum.accumulate(np.where(np.concatenate([[True], row[1:] != row[:-1]]), here, 0))
    out = []
    for other in [here - hop for hop in HOPS] + [block - 1]:
        ok = other >= 0
        ok[ok] = (code[other[ok]] == code[ok]) & (row[other[ok]] != row[ok])
        i, j = here[ok], other[ok]
        right = _common(after[0][i], after[1][i], after[0][j], after[1][j])
        left = _common(before[0][i], before[1][i], before[0][j], before[1][j])
        long = left + gram + right >= least
        for x in (i[long], j[long]):
            out.append(np.stack([row[x], at[x] - left[long], at[x] + gram + right[long]], axis=1))
    return out


def _hot_spans(kept: DataFrame, gram: int, least: int) -> DataFrame:
    """``(row, first, end)`` of every passage of ``least`` words that another document has too, around grams with more suffixes than neighbours reach.

    Suffixes of the same surroundings are one content, so copies are keyed once; a key keeps its least and
    greatest row and no pairs.
    """
    member = kept.where("common").withColumn("content", F.xxhash64("gram", "after", "before"))
    contents = member.groupBy("content").agg(F.first("gram").alias("gram"), F.first("after").alias("after"), F.first("before").alias("before"), F.min("row").alias("low"), F.max("row").alias("high"))
    room = least - gram
    left, right = (F.octet_length(c) / 2 for c in ("before", "after"))
    shifts = F.filter(F.sequence(F.lit(0), F.lit(room)), lambda s: (s <= left) & (room - s <= right))
    slim = contents.select("content", "gram", "low", "high", "before", "after", F.explode(shifts).alias("shift"))
    key = F.xxhash64("gram", "shift", F.substring(F.col("before"), F.lit(1), 2 * F.col("shift")), F.substring(F.col("after"), F.lit(1), 2 * (room - F.col("shift"))))
    keyed = slim.select("content", "low", "high", F.col("shift").cast("byte").alias("shift"), key.alias("key"))
    common = keyed.groupBy("key").agg(F.min("low").alias("p"), F.max("high").alias("q")).where("p <> q").select("key")
    # contents of several documents have all their passages in common; those of one meet its own suffixes only
    single = keyed.where("low = high").join(common, "key", "left_semi").select("content", F.col("low").alias("row"), F.col("shift").cast("int").alias("shift"))
    ends = single.groupBy("content", "row").agg(F.collect_set("shift").alias("shifts"))
    found = member.select("content", "row", "at").join(ends, ["content", "row"]).select("row", "at", F.explode("shifts").alias("shift"))
    apart = found.select("row", (F.col("at") - F.col("shift")).alias("first"), (F.col("at") - F.col("shift") + least).alias("end"))
    # one content may be that of a third of all rows, which are dealt over SALTS parts
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = contents.where("low <> high").select("content", salts)
    several = member.where(left + gram + right >= least).select("content", "row", "at", left.cast("int").alias("l"), right.cast("int").alias("r")).withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int")).join(salted, ["content", "salt"], "left_semi")
    whole = several.select("row", (F.col("at") - F.col("l")).alias("first"), (F.col("at") + gram + F.col("r")).alias("end"))
    return apart.union(whole)


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, gram: int = GRAM) -> DataFrame:
    """``(row, spans)`` for documents that share a passage of ``least_words`` words or more with another document.

    ``docs`` has ``row long, text string``; spans are joined word ranges ``(first, end)`` in order. Words are
    lower-cased runs without white space. A null or short text shares nothing; a copy of a document
    shares all of it; passages repeated only inside one document do not count.
    """
    spark, window = docs.sparkSession, least_words - gram + 1
    shared.small_batches(spark)
    kept = shared.saved(_suffixes(docs, gram, window), "suffixes")
    shared.small_batches(spark, 4000)
    order = ["gram", "after", "row", "at"]
    ordered = kept.repartitionByRange(shared.partitions(spark), *order).sortWithinPartitions(*order)
    names = ["gram", "after", "before", "row", "at"]
    edge = ", ".join(["part int", "gram long", "after binary", "before binary", "row long", "at int", "first int", "end int"])

    def task(batches):
        from pyspark import TaskContext

        part, tail, head = TaskContext.get().partitionId(), None, None
        margin = max(HOPS)

        def batch_of(spans: np.ndarray, table: pa.Table | None):
            k = len(spans)
            cols = [pa.array(np.full(k, -1, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(spans[:, 0]), pa.nulls(k, pa.int32()), pa.array(spans[:, 1].astype(np.int32)), pa.array(spans[:, 2].astype(np.int32))]
            if table is not None:
                k = table.num_rows
                cols = [pa.array(np.full(k, part, np.int32)), *[table.column(c).combine_chunks() for c in names], pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32())]
            return pa.RecordBatch.from_arrays(cols, names=["part", *names, "first", "end"])

        for batch in batches:
            table = pa.Table.from_batches([batch]).select(names)
            head = table.slice(0, margin) if head is None else head
            table = table if tail is None else pa.concat_tables([tail, table])
            spans = np.unique(np.concatenate(_matches(table, gram, window, least_words)), axis=0)
            if len(spans):
                yield batch_of(spans, None)
            tail = table.slice(max(0, table.num_rows - margin - 1))
        if tail is not None:
            yield batch_of(np.zeros((0, 3), np.int64), head)
            yield batch_of(np.zeros((0, 3), np.int64), tail)

    found = shared.saved(ordered.select(*names).mapInArrow(task, edge), "matches")
    # where two parts meet: a few rows of each, which follow the number of parts and not the input
    edges = found.where("part >= 0").select(*names).distinct().coalesce(1).sortWithinPartitions(*order)

    def across(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if tables:
            spans = np.unique(np.concatenate(_matches(pa.concat_tables(tables), gram, window, least_words)), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1].astype(np.int32)), pa.array(spans[:, 2].astype(np.int32))], names=["row", "first", "end"])

    spans = found.where("part < 0").select("row", "first", "end").union(edges.mapInArrow(across, "row long, first int, end int")).union(_hot_spans(kept, gram, least_words))
    ordered_spans = F.array_sort(F.collect_set(F.struct("first", "end")))
    empty = F.array().cast("array<struct<first:int,end:int>>")

    def grow(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["first"]), joined).otherwise(F.concat(done, F.array(x)))

    return spans.groupBy("row").agg(ordered_spans.alias("s")).select("row", F.aggregate("s", empty, grow).alias("spans"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: Every window of 50 words that two rows or more have, joined where they touch.
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, p - 1 AS p, md5(array_to_string(w[p:p + {LEAST_WORDS - 1}], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - {LEAST_WORDS - 2})) AS p FROM d WHERE len(w) >= {LEAST_WORDS})),
hit AS (SELECT r, p FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(DISTINCT r) > 1)),
island AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= {LEAST_WORDS} THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT r, min(p) AS a, max(p) + {LEAST_WORDS} AS b FROM island GROUP BY r, g)
SELECT doc_id, count(*) AS n_passages, CAST(sum(b - a) AS BIGINT) AS n_words, string_agg(a || ':' || b, ',' ORDER BY a) AS passages FROM span JOIN d USING (r) GROUP BY r, doc_id"""


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share passages of 50 words or more with others: how many, of how many words, and the word ranges."""
    docs = shared.table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeated_passages(docs)
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"], s["end"])), ",")
    return docs.select("row", "doc_id").join(found, "row").select("doc_id", F.size("spans").cast("long").alias("n_passages"), words.alias("n_words"), joined.alias("passages"))
