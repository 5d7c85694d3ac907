"""Phrase collocation mining by Toivonen's sampling: frequent phrases of each language, scored by how tightly they hold together.

A sample of the documents proposes phrases of one to four words at a lowered threshold. A full pass counts the proposals
and their negative border: every phrase that is not proposed itself but whose two shorter ends are, which is
decided where the phrase stands, so the border is never listed. Where a border phrase turns out frequent, the proposals
were too few: the frequent phrases become the next proposals, and a further pass counts what they add, until
no frequent phrase lies outside the proposals. Nothing is lost on the way, since all shorter parts of a frequent
phrase are frequent: after pass k all frequent phrases of k words are known, so four passes close it at the latest.

The first full pass counts 62-bit keys of phrases: two phrases with one key can only make a count too high. Later
passes count the texts, the second one those of all phrases whose keys are frequent, and these counts alone are used. Proposals go
to the tasks as a bitmap of a fixed number of bits, whatever the corpus holds; a phrase that it takes in by chance is
counted in vain and changes nothing.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import shared
from .divergence import Numbers

LONGEST, LEAST, TOP = 4, 30, 2000
SAMPLE_SHARE, SAMPLE_LEAST = 0.125, 2
#: Bits of the bitmap of proposals (a power of two): 4 MB. A larger corpus wants more, so that few phrases are counted in vain.
BITS = 1 << 25
FLUSH_WORDS = 1_000_000
SALTS = 8
#: Lower case, and one mark for all that ends a piece.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 10)
_TURN = np.uint64(0x9E3779B97F4A7C15)


class Stretch:
    """The words of some documents as numbers in text order; 0 stands between two pieces. ``lang`` gives the language of each place."""

    def __init__(self):
        self.words, self.langs = Numbers({b".": 0}), Numbers()
        self.ids, self.sizes, self.lang_of = array("i"), [], []

    def add(self, lang: str, text: bytes) -> None:
        before = len(self.ids)
        # a mark ends a piece, so it can stand as a word of its own that no text has
        self.ids.extend(map(self.words.__getitem__, text.translate(_PLAIN).replace(b".", b" . ").split()))
        self.ids.append(0)
        self.sizes.append(len(self.ids) - before)
        self.lang_of.append(self.langs[lang])

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.ids, np.int32), np.repeat(np.array(self.lang_of, np.int64), self.sizes)


def stretches(batches, share: float = 1.0) -> Iterator[Stretch]:
    from pyspark import TaskContext

    row, held = TaskContext.get().partitionId() << 36, Stretch()
    for batch in batches:
        data, offsets = shared.text_buffer(batch.column("text"))
        rows = np.arange(row, row + batch.num_rows)
        row += batch.num_rows
        for k in np.flatnonzero((shared.mix(rows.astype(np.uint64) * _TURN) >> np.uint64(32)) < share * 2**32).tolist():
            held.add(batch.column("lang")[k].as_py(), data[offsets[k] : offsets[k + 1]].tobytes())
            if len(held.ids) >= FLUSH_WORDS:
                yield held
                held = Stretch()
    if held.ids:
        yield held


class Proposals:
    """A fixed bitmap of keys with two bits a key."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def has(self, key: np.ndarray) -> np.ndarray:
        hit = np.ones(len(key), bool)
        for place in (key & self.mask, key >> np.uint64(32) & self.mask):
            hit &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return hit


def phrase_keys(stretch: Stretch, proposals: list[Proposals] | None):
    """For each length: ``(length, places, keys, now, member)`` of the phrases to look at.

    Without proposals every phrase is looked at. Else ``now`` marks those that the last of the proposals makes countable
    (both shorter ends are in it) and no earlier one did, and ``member`` those that the last one has itself.
    """
    ids, lang = stretch.arrays()
    spell = np.array([xxh3_64_intdigest(w) for w in stretch.words], np.uint64)
    voice = np.array([xxh3_64_intdigest(x.encode()) for x in stretch.langs], np.uint64)
    keys, inside = np.zeros(len(ids) + 1, np.uint64), []
    at = np.flatnonzero(ids)
    for length in range(1, LONGEST + 1):
        if length > 1:
            at = at[ids[at + (length - 1)] > 0]
        if proposals is not None and length > 1:
            ends = [have[at] & have[at + 1] for have in inside]
            any_of = np.logical_or.reduce(ends)
            at, ends = at[any_of], [e[any_of] for e in ends]
        if not len(at):
            return
        found = shared.mix((keys[at] if length > 1 else voice[lang[at]]) * _TURN + spell[ids[at + (length - 1)]])
        found = found & ~np.uint64(3) | np.uint64(length - 1)
        keys[at] = found
        if proposals is None:
            yield length, at, found, np.ones(len(at), bool), np.ones(len(at), bool)
            continue
        members = [p.has(found) & (ends[k] if length > 1 else True) for k, p in enumerate(proposals)]
        if length == 1:
            now = np.full(len(at), len(proposals) == 1)
        else:
            now = ends[-1] & ~np.logical_or.reduce([*ends[:-1], np.zeros(len(at), bool)])
        yield length, at, found, now, members[-1]
        inside = []
        for member in members:
            have = np.zeros(len(ids) + 1, bool)
            have[at[member]] = True
            inside.append(have)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def key_counts(docs: DataFrame, proposals: list | None, share: float = 1.0) -> DataFrame:
    """``(key, n)``: how often the phrases to count occur; ``proposals`` are broadcast bitmaps."""

    def task(batches):
        bitmaps = None if proposals is None else [Proposals(b.value) for b in proposals]
        for stretch in stretches(batches, share):
            keys = [found[now] for _, _, found, now, _ in phrase_keys(stretch, bitmaps)]
            key, n = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_counts=True)
            table = pa.Table.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])
            yield from table.to_batches(max_chunksize=100_000)

    return _texts(docs).mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def bitmap(keys: DataFrame, size: int):
    """The keys as a broadcast bitmap of ``size`` bits. At most ``size / 64`` words reach the driver."""
    spark = keys.sparkSession
    low, high = f"key & {size - 1}L", f"shiftrightunsigned(key, 32) & {size - 1}L"
    bits = keys.selectExpr(f"explode(array({low}, {high})) place").selectExpr("place div 64 word", "shiftleft(1L, cast(place % 64 as int)) bit")
    got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[np.asarray(got.column("word"))] = np.asarray(got.column("bits")).view(np.uint64)
    return spark.sparkContext.broadcast(words)


def same_phrases(lang: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For phrases by language and columns of word numbers: the number of each one's text, and by text a place where it stands and how often it occurs.

    Equal numbers of words mean equal texts; keys play no part. Any place of a text will do: asking for the first one makes the sort a slower, stable one.
    """
    code = lang
    for word in words:
        _, code, n = np.unique(code << 32 | word, return_inverse=True, return_counts=True)
    place = np.empty(len(n), np.int64)
    place[code] = np.arange(len(code))
    return code, place, n


def text_counts(docs: DataFrame, proposals: list, known: bool) -> DataFrame:
    """``(lang, phrase, words, key, f)``: phrases counted by their texts. These are the phrases that the last of the proposals makes countable and no
    earlier one did, and with ``known`` the last proposals themselves; then ``words`` 0 has the number of all words of a language."""

    def task(batches):
        names = ["lang", "phrase", "words", "key", "n"]
        bitmaps = [Proposals(b.value) for b in proposals]
        for stretch in stretches(batches):
            word, langs = list(stretch.words), pa.array(list(stretch.langs), pa.string())
            ids, lang = stretch.arrays()
            rows = []
            if known:
                n, none = np.bincount(lang[ids > 0], minlength=len(langs)), np.zeros(len(langs), np.int64)
                rows.append(pa.table([langs, pa.array([""] * len(langs)), pa.array(none.astype(np.int32)), pa.array(none), pa.array(n)], names))
            for length, at, found, now, member in phrase_keys(stretch, bitmaps):
                wanted = now | member if known else now
                at, found = at[wanted], found[wanted]
                if not len(at):
                    continue
                _, first, n = same_phrases(lang[at], [ids[at + k] for k in range(length)])
                spelt = np.stack([ids[at[first] + k] for k in range(length)], axis=1).tolist()
                texts = pa.array([b" ".join([word[i] for i in phrase]) for phrase in spelt], pa.binary()).cast(pa.string())
                rows.append(pa.table([langs.take(pa.array(lang[at[first]])), texts, pa.array(np.full(len(n), length, np.int32)), pa.array(found[first].view(np.int64)), pa.array(n)], names))
            if rows:
                yield from pa.concat_tables(rows).to_batches(max_chunksize=50_000)

    counted = _texts(docs).mapInArrow(task, "lang string, phrase string, words int, key long, n long")
    return counted.groupBy("lang", "phrase", "words", "key").agg(F.sum("n").alias("f"))


def phrase_counts(docs: DataFrame, least: int = LEAST, share: float = SAMPLE_SHARE, size: int = BITS) -> DataFrame:
    """``(lang, phrase, words, key, f)`` of every phrase of up to four words that occurs ``least`` times; ``words`` 0 has the number of all words of the language.

    The first full pass counts keys, as it meets most border phrases; later ones count texts, the second those of all phrases known by then.
    """
    often = F.col("f") >= least
    proposals = [bitmap(key_counts(docs, None, share).where(F.col("n") >= SAMPLE_LEAST), size)]
    keys = shared.saved(key_counts(docs, proposals).where(F.col("n") >= least).select("key"), "frequent-keys")
    counts = None
    while True:
        proposals.append(bitmap(keys, size))
        latest = proposals[-1]
        found = text_counts(docs, proposals, known=counts is None).where(often | (F.col("words") == 0))
        found = shared.saved(found, "phrase-counts")
        counts = found if counts is None else counts.unionByName(found)

        def outside(batches, latest=latest):
            for batch in batches:
                key = np.asarray(batch.column("key")).view(np.uint64)
                yield batch.filter(pa.array(~Proposals(latest.value).has(key) & ((key & np.uint64(3)) < np.uint64(LONGEST - 1))))

        if found.where("words > 0").select("key").mapInArrow(outside, "key long").isEmpty():
            for used in proposals:
                used.destroy()
            return counts
        keys = keys.union(found.where("words > 0").select("key"))


def _part(first: str, last: str) -> str:
    """SQL: the words ``first`` to ``last`` (from 1) of the array ``w``."""
    return f"array_join(slice(w, {first}, {last} - {first} + 1), ' ')"


def scored(counts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: ``lang, phrase, a, l, r, score``.

    A word may begin a large part of all phrases: counts of parts go to several places, and each candidate asks one of them.
    """
    parts = counts.where(f"words between 1 and {LONGEST - 1}").selectExpr("lang", "phrase part", "f", f"explode(sequence(0, {SALTS - 1})) salt")
    cuts = candidates.selectExpr("*", "split(phrase, ' ') w", "explode(sequence(1, words - 1)) k", f"cast(pmod(xxhash64(phrase), {SALTS}) as int) salt")
    cuts = cuts.selectExpr("lang", "phrase", "f a", "k", "salt", f"{_part('1', 'k')} first_part", f"{_part('k + 1', 'words')} rest")
    for side, name in (("first_part", "l"), ("rest", "r")):
        cuts = cuts.join(parts.withColumnsRenamed({"part": side, "f": name}), ["lang", side, "salt"])
    cuts = cuts.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x"))
    return best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: float = SAMPLE_SHARE, size: int = BITS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language.

    A null text is an empty one, a null lang ``und``; each row is a document, repeated ones too; an empty table gives no rows; ties in the
    score go by count, then by the bytes of the phrase; extra columns are ignored. A very long text is one document of a
    stretch. ``share`` of the documents proposes, in a bitmap of ``size`` bits; the result depends on neither.
    """
    spark = docs.sparkSession
    counts = phrase_counts(docs, least, share, size)
    candidates = counts.where("words > 1")
    spans = [(length, k, m) for length in range(3, LONGEST + 1) for m in range(2, length) for k in range(1, length - m + 2)]
    inner = F.array_distinct(F.array(*[F.when(F.col("words") == length, F.expr(_part(str(k), str(k + m - 1)))) for length, k, m in spans]))
    wider = candidates.where("words > 2").withColumn("w", F.split("phrase", " ")).select("lang", F.explode(inner).alias("phrase"), "f").where("phrase is not null")
    wider = wider.groupBy("lang", "phrase").agg(F.max("f").alias("wider"))
    kept = candidates.join(wider, ["lang", "phrase"], "left")
    kept = kept.where("wider is null or cast(100 as decimal(3,0)) * cast(wider as decimal(19,0)) < cast(80 as decimal(3,0)) * cast(f as decimal(19,0))").drop("wider")
    found = scored(counts, kept)
    # the first of each part of a language, then the first of these
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = shared.partitions(spark, 16)
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("words = 0").selectExpr("lang", "f n")
    return found.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(shared.table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS k, unnest([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k} + 2)]) AS phrase FROM w" for k in range(1, LONGEST + 1))}),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT lang, phrase, f, k, w, i, j FROM c, range(1, 4) a(i), range(2, 5) b(j) WHERE i < j AND j <= k AND (i > 1 OR j < k)),
x AS (SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS m FROM s GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN x USING (lang, phrase) WHERE x.m IS NULL OR 100::HUGEINT * x.m < 80::HUGEINT * c.f),
cut AS (SELECT lang, phrase, f AS a, i, array_to_string(w[1:i], ' ') AS lp, array_to_string(w[i + 1:k], ' ') AS rp FROM kept, range(1, 4) t(i) WHERE i < k),
sc AS (SELECT cut.lang, cut.phrase, a, i, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= {TOP}
"""
