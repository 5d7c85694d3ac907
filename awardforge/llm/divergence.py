"""Source divergence audit by chunk factorization: how far the term use of each source lies from its language's and from every other source's.

Documents are factored into white-space chunks, counted per document. What leaves a task is one row for each
chunk of a language and source: its occurrences, its documents, and the least and greatest number of those
documents. Rows of one chunk meet in one place, sorted, so each globally distinct chunk is cut into terms once
and its terms go back to all its rows. Then rows of one term meet, again sorted: occurrences add up, and
documents are united. A chunk of one or two documents names them exactly by its least and greatest one, and one
of three or more needs no names, so the union answers "in at least three documents" exactly although no row
ever lists documents. Probabilities are whole billionths; the sums over all kept terms are taken in blocks of terms,
each of which holds the counts of all sources as one matrix.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: A term is kept in a language where this many of its documents have it. The union of named documents is exact up to three.
LEAST_DOCS = 3
SCALE, TOP_TERMS = 1_000_000_000, 200
FLUSH_WORDS = 2_000_000
BLOCK_ROWS = 400_000
_CELLS = 1 << 20
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")

USES = "lang string, source string, chunk string, n long, docs long, low long, span long"
TERM_USES = "lang string, source string, term string, n long, docs long, low long, high long"
KEPT = "lang string, source string, term string, n long, total long, first int"


class Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _groups(docs: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(name("lang"), name("source"), F.col("text").cast("string").alias("text"))


def chunk_uses(docs: DataFrame) -> DataFrame:
    """Chunks counted per document (``bytes.split``: ASCII white space), summed over the documents of one stretch of a task. Documents are numbered by their place."""

    def task(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        chunks, groups, ids, sizes, group_of = Numbers(), Numbers(), array("i"), [], []

        def flush():
            doc = np.repeat(np.arange(len(sizes)), sizes)
            pair, n = np.unique(doc << 32 | np.frombuffer(ids, np.int32), return_counts=True)
            doc, chunk = pair >> 32, pair & 0xFFFFFFFF
            key = np.array(group_of, np.int64)[doc] << 32 | chunk
            order = np.argsort(key, kind="stable")  # documents stay in order
            key, n, doc = key[order], n[order], doc[order] + (row - len(sizes))
            run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            docs = np.diff(np.append(run, len(key)))
            names, texts = list(groups), pa.array(list(chunks), pa.binary()).cast(pa.string())
            lang, source = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
            group, chunk = key[run] >> 32, key[run] & 0xFFFFFFFF
            # many documents need no names, and one document has no span: zeros cost nothing on the way
            few = docs < LEAST_DOCS
            low, span = np.where(few, doc[run], 0), np.where(few, doc[run + docs - 1] - doc[run], 0)
            columns = [lang.take(pa.array(group)), source.take(pa.array(group)), texts.take(pa.array(chunk)), *map(pa.array, (np.add.reduceat(n, run), docs, low, span))]
            table = pa.Table.from_arrays(columns, names=_names(USES))
            yield from table.to_batches(max_chunksize=50_000)

        for batch in batches:
            data, offsets = shared.text_buffer(batch.column("text"))
            for k, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                before = len(ids)
                ids.extend(map(chunks.__getitem__, data[offsets[k] : offsets[k + 1]].tobytes().lower().split()))
                sizes.append(len(ids) - before)
                group_of.append(groups[group])
                row += 1
                if len(ids) >= FLUSH_WORDS:
                    yield from flush()
                    chunks, groups, ids, sizes, group_of = Numbers(), Numbers(), array("i"), [], []
        if ids:
            yield from flush()

    return _groups(docs).mapInArrow(task, USES)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _terms_back(batches):
    """Rows sorted by chunk: each distinct chunk is cut once, and its distinct terms go to all its rows with their repeats."""
    last: tuple[str, list] = ("", [])
    for batch in batches:
        coded = batch.column("chunk").dictionary_encode()
        terms, times, size = [], [], []
        for chunk in coded.dictionary.to_pylist():
            if chunk != last[0]:
                last = (chunk, TERM.findall(chunk))
            found = dict.fromkeys(last[1], 0)
            for term in last[1]:
                found[term] += 1
            terms.extend(found)
            times.extend(found.values())
            size.append(len(found))
        code, size = np.asarray(coded.indices), np.array(size, np.int64)
        each = size[code]
        row = np.repeat(np.arange(len(code)), each)
        at = np.arange(len(row)) + np.repeat((np.cumsum(size) - size)[code] - (np.cumsum(each) - each), each)
        columns = {c: batch.column(c).take(pa.array(row)) for c in ("lang", "source", "n", "docs", "low", "high")}
        columns["term"] = pa.array(terms, pa.string()).take(pa.array(at))
        columns["n"] = pc.multiply(columns["n"], pa.array(np.array(times, np.int64)[at]))
        table = pa.Table.from_arrays([columns[c] for c in _names(TERM_USES)], names=_names(TERM_USES))
        yield from table.to_batches(max_chunksize=50_000)


def _kept_runs(table: pa.Table) -> pa.Table:
    """Whole runs of (lang, term): the counts of each source, where at least LEAST_DOCS documents have the term."""
    lang, term, source = (table.column(c).combine_chunks() for c in ("lang", "term", "source"))
    n, docs, low, high = (np.asarray(table.column(c)) for c in ("n", "docs", "low", "high"))
    fresh = np.concatenate([[True], np.asarray(pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])))])
    run, begins = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    few = docs < LEAST_DOCS
    named = np.unique(np.stack([np.concatenate([run[few], run[few]]), np.concatenate([low[few], high[few]])], axis=1), axis=0)
    kept = (np.maximum.reduceat(docs, begins) >= LEAST_DOCS) | (np.bincount(named[:, 0], minlength=len(begins)) >= LEAST_DOCS)
    total = np.add.reduceat(n, begins)
    coded = source.dictionary_encode()
    key = run << 32 | np.asarray(coded.indices)
    order = np.argsort(key, kind="stable")
    order = order[kept[run[order]]]
    if not len(order):
        return pa.Table.from_arrays([pa.array([], t) for t in (pa.string(),) * 3 + (pa.int64(),) * 2 + (pa.int32(),)], names=_names(KEPT))
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    of = key[head] >> 32
    first = np.concatenate([[True], of[1:] != of[:-1]]).astype(np.int32)
    at = pa.array(begins[of])
    columns = [lang.take(at), coded.dictionary.take(pa.array(key[head] & 0xFFFFFFFF)), term.take(at), *map(pa.array, (np.add.reduceat(n[order], head), total[of], first))]
    return pa.Table.from_arrays(columns, names=_names(KEPT))


def _merge(batches):
    """Cuts the sorted rows between two terms, so that every run is seen whole; a run has a row for each source and spelling."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        lang, term = table.column("lang"), table.column("term")
        # rows of the last term wait for the next batch
        last = pc.and_(pc.equal(term, term[-1]), pc.equal(lang, lang[-1]))
        cut = pc.index(last, True).as_py()
        if cut:
            yield from _kept_runs(table.slice(0, cut)).to_batches()
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from _kept_runs(pa.Table.from_batches(held)).to_batches()


def term_uses(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, total, first)``: the occurrences of each kept term in each source that has it, and in its language; ``first`` is 1 in one row of each term."""
    uses = chunk_uses(docs).repartition("chunk").groupBy("chunk", "lang", "source")
    uses = uses.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("low").alias("low"), F.max(F.col("low") + F.col("span")).alias("high"))
    terms = uses.sortWithinPartitions("chunk").mapInArrow(_terms_back, TERM_USES)
    return terms.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge, KEPT)


def share(count: str, total: str, kinds: str) -> str:
    """SQL: 1 + floor(SCALE * (count + 1) / (total + kinds)) by long division in three steps of a thousand, so that nothing passes 64 bits."""
    a, m = f"({count} + 1)", f"({total} + {kinds})"
    rest1 = f"({a} * 1000 % {m})"
    rest2 = f"({rest1} * 1000 % {m})"
    return f"1 + ({a} * 1000 div {m}) * 1000000 + ({rest1} * 1000 div {m}) * 1000 + ({rest2} * 1000 div {m})"


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, rest = np.zeros(count.shape, np.int64), count + 1
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


def _block_pairs(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """For each ordered pair of a language's sources, f summed over the kept terms of one block."""
    names = groups.column("source").to_pylist()
    place, size = {s: k for k, s in enumerate(names)}, len(names)
    total = np.asarray(groups.column("tokens")) + np.asarray(groups.column("kinds"))
    sums = np.zeros((size, size), np.int64)
    coded = terms.column("term").combine_chunks().dictionary_encode()
    row, kinds = np.asarray(coded.indices), len(coded.dictionary)
    column, n = np.array([place[s] for s in terms.column("source").to_pylist()], np.int64), np.asarray(terms.column("n"))
    order = np.argsort(row, kind="stable")
    row, column, n = row[order], column[order], n[order]
    step = max(1, _CELLS // max(size, 1))
    for at in range(0, kinds, step):
        a, b = np.searchsorted(row, [at, at + step])
        counts = np.zeros((min(step, kinds - at), size), np.int64)
        counts[row[a:b] - at, column[a:b]] = n[a:b]
        p = _shares(counts, total)
        for g in range(size):
            sums[g] += ((p[:, g : g + 1] - p) ** 2 // p).sum(axis=0)
    g, h = np.nonzero(~np.eye(size, dtype=bool))
    source = pa.array(names, pa.string())
    return pa.Table.from_arrays([pa.repeat(key[0], len(g)).cast(pa.string()), source.take(pa.array(g)), source.take(pa.array(h)), pa.array(sums[g, h])], names=["lang", "source", "item", "value"])


def divergences(docs: DataFrame, top_terms: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: other sources by divergence (part ``pair``), terms used more than in the language (part ``term``, ``top_terms`` of them).

    Null text, lang and source are the empty string; each row is a document, repeated ones too; a group without any
    term takes part with zero counts; an empty table gives no rows; ties go by item; extra columns are ignored. A very long
    text is one document of a stretch. Work for pairs is kept terms times sources squared, as the exact floor of each term asks for.
    """
    spark = docs.sparkSession
    uses = shared.saved(term_uses(docs), "term-uses")
    tokens = uses.groupBy("lang", "source").agg(F.sum("n").alias("tokens"))
    langs = uses.groupBy("lang").agg(F.sum("n").alias("lang_tokens"), F.sum("first").cast("long").alias("kinds"))
    groups = _groups(docs).select("lang", "source").distinct().join(tokens, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = shared.saved(groups.na.fill(0, ["tokens", "lang_tokens", "kinds"]), "term-groups")
    terms = uses.join(groups, ["lang", "source"]).withColumn("p", F.expr(share("n", "tokens", "kinds"))).withColumn("q", F.expr(share("total", "lang_tokens", "kinds")))
    terms = terms.where("p > q").selectExpr("lang", "source", "'term' part", "term item", "(p - q) * (p - q) div q value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)
    blocks = uses.count() // BLOCK_ROWS + 1
    dealt = uses.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    everywhere = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = dealt.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block")).applyInArrow(lambda key, a, b: _block_pairs(tuple(k.as_py() for k in key), a, b), "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by))
    return pairs.unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(shared.table(spark, sf_dir, "documents"))


def _sql_share(count: str, total: str) -> str:
    return f"(1 + ({SCALE}::HUGEINT * ({count} + 1)) // ({total} + v))"


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT s.lang, s.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_sql_share("coalesce(c.n, 0)", "g.n")} AS p, {_sql_share("k.total", "l.lang_n")} AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
