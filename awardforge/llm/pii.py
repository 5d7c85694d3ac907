"""Personal data: base patterns, and terms that give protected entities away. DataFrame functions only.

The base spans are matches of four patterns. Each distinct value of a base span is a protected entity c;
terms t are the words of the documents that mention it. With the share p of documents as probability, a term
gives an entity away if it explains most of what the entity's mention would tell:

    PMI(c; t) = log2 p(c, t) / (p(c) p(t))  >=  alpha * IC(c) = alpha * -log2 p(c)

that is, if p(c | t) >= p(c)^(1 - alpha), and the two meet in ``least_contexts`` different texts at least
(and, for a common entity, in more than chance would bring together): a word that stands beside an address once says nothing about it, and a page copied many times is one text.
Every occurrence of such a term in any document that mentions the entity is removed where the term appears
with its entity only (PMI = IC), else generalised to its kind. All counts are of documents, over all of
them: words are counted by partial aggregation before the shuffle, and pairs only for entities that
are mentioned in ``least_contexts`` texts. An entity with more than a hundredth of all mentions is dealt over
``SHARES`` keys in each join; there are at most a hundred of them.

Places in a text come from running sums in log n passes over its matches and text is cut from blocks, so a text
of tens of thousands of matches takes time in proportion to n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns with possessive repeats and a look at the character before, so that a search takes
#: time in proportion to the text; \G lets a match begin where the last one ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
ALPHA, LEAST_CONTEXTS = 0.9, 3
#: Bits that the documents of a pair must amount to (their number times IC), so that a word of a few documents does not
#: count as a sign of an entity that a good part of all documents mention.
EVIDENCE = 16
#: Keys that the mentions of a hot entity are dealt over; hot is more than one part in ``SHARES`` of all mentions.
SHARES = 100
#: Code points of a block that text is cut from.
BLOCK_BITS = 10

def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


#: A term: a whole run of letters and digits.
TERM = r"[\p{L}\p{N}]++"

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of all values up to each place, for values of 0 or more: each pass doubles the reach."""
    reaches = F.array(*[F.lit(1 << k) for k in range(31)])

    def passes(first: Column) -> Column:
        def step(done: Column, reach: Column) -> Column:
            return F.transform(done, lambda x, i: join(x, F.coalesce(F.get(done, i - reach), F.lit(0))))

        return F.aggregate(F.filter(reaches, lambda r: r < F.size(first)), first, step)

    return _let(values, passes)


def _found(text: Column, pattern: str) -> Column:
    """``(start, end, value)`` of each match: what lies between the matches gives their places."""

    def placed(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(values))
        ends = _running(F.zip_with(gaps, values, lambda g, v: F.length(g) + F.length(v)), lambda x, y: x + y)
        return F.zip_with(ends, values, lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _spans(kind: str, text: Column) -> Column:
    """Valid matches of one kind."""
    valid = F.filter(_found(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    spans = F.transform(valid, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(SPAN))


def _cut(blocks: Column, a: Column, b: Column) -> Column:
    """The text from ``a`` to ``b``, exclusive, of a text in blocks."""
    first, last, size = F.shiftright(a, BLOCK_BITS), F.shiftright(b, BLOCK_BITS), 1 << BLOCK_BITS
    of = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    middle = F.array_join(F.slice(blocks, first + 2, last - first - 1), "")
    across = F.concat(F.substr(of(first), a % size + 1, F.lit(size)), middle, F.substr(of(last), F.lit(1), b % size))
    return F.when(first == last, F.substr(of(first), a % size + 1, b - a)).otherwise(across)


def _replaced(text: Column, cuts: Column, say: Callable[[Column, Column], Column]) -> Column:
    """``text`` without its ``cuts (a, b, ...)``, ordered by start: ``say(cut, it starts behind all before)`` stands for each."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))

    def whole(s: Column) -> Column:
        def joined(reach: Column) -> Column:
            def piece(c: Column, i: Column) -> Column:
                at = F.coalesce(F.get(reach, i - 1), F.lit(0))
                return F.concat(_cut(s["blocks"], at, F.greatest(c["a"], at)), say(c, c["a"] >= at))

            end = F.coalesce(F.get(reach, F.size(reach) - 1), F.lit(0))
            return F.concat(F.array_join(F.transform(s["cuts"], piece), ""), _cut(s["blocks"], end, F.length(text)))

        return _let(_running(F.transform(s["cuts"], lambda c: c["b"]), F.greatest), joined)

    return _let(F.struct(blocks.alias("blocks"), cuts.alias("cuts")), whole)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: the base spans by kind as listed, then start. A null text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("_text", text)
    for kind in PATTERNS:
        df = df.withColumn(f"_{kind}", _spans(kind, F.col("_text")))
    return df.withColumn("base", F.concat(*[f"_{kind}" for kind in PATTERNS])).drop("_text", *[f"_{kind}" for kind in PATTERNS])


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _dealt(mention: DataFrame, hot: DataFrame) -> DataFrame:
    """``mention`` with ``share``: rows of a hot entity are dealt over all shares."""
    share = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SHARES))).otherwise(0)
    return mention.join(F.broadcast(hot), "entity", "left").withColumn("share", share.cast("int")).drop("hot")


def _copied(facts: DataFrame, hot: DataFrame) -> DataFrame:
    """``facts`` with ``share``: those of a hot entity once a share."""
    shares = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    return facts.join(F.broadcast(hot), "entity", "left").withColumn("share", F.explode(shares)).drop("hot")


def mentions(found: DataFrame, least_contexts: int = LEAST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """``(row, entity, n_entity)`` of entities in ``least_contexts`` texts at least, and the hot ones ``(entity, hot)``, at most ``SHARES`` of them."""
    mention = found.where(F.size("base") > 0).select(F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"), "row", "context")
    counted = shared.saved(mention.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.countDistinct("context").alias("contexts")), "entities")
    total = counted.agg(F.sum("n_entity").alias("n_mentions"))
    hot = counted.crossJoin(F.broadcast(total)).where(F.col("n_entity") * SHARES > F.col("n_mentions")).select("entity", F.lit(True).alias("hot"))
    known = counted.where(F.col("contexts") >= least_contexts).select("entity", "n_entity")
    met = _dealt(mention.select("entity", "row"), hot).join(_copied(known, hot), ["entity", "share"])
    return shared.saved(met.select("row", "entity", "n_entity"), "mentions"), hot


def disclosures(found: DataFrame, met: DataFrame, alpha: float = ALPHA, least_contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """``(entity, term, whole)``: terms that give an entity away; whole if they appear with it only.

    ``found`` has ``row, base, context`` and the text with its base spans cut out as ``rest``; ``met`` its :func:`mentions`.
    """
    total = found.agg(F.count(F.lit(1)).alias("n_all"))
    # a text goes to its row once, not once an entity; the pairs are summed by a partial aggregation
    of_row = met.groupBy("row").agg(F.collect_list(F.struct("entity", "n_entity")).alias("entities"))
    texts = found.where(F.size("base") > 0).select("row", "context", "rest").join(of_row, "row")
    words = texts.select("context", "entities", F.explode(F.array_distinct(_terms(F.col("rest")))).alias("term"))
    pairs = words.select("context", "term", F.inline("entities"))
    by_text = pairs.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"), F.first("n_entity").alias("n_entity"))
    pairs = by_text.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("contexts"), F.first("n_entity").alias("n_entity")).where(F.col("contexts") >= least_contexts)
    pairs = shared.saved(pairs, "pairs")
    # all words are counted before the join, task by task, so that the join sees a word once and not once a document
    n_term = found.select(F.explode(F.array_distinct(_terms(F.col("rest")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    scored = pairs.join(n_term, "term").crossJoin(F.broadcast(total))
    information = F.log2(F.col("n_all") / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * F.col("n_all") / (F.col("n_entity") * F.col("n_term")))
    return scored.where((F.col("n_both") * information >= EVIDENCE) & (pmi >= alpha * information)).select("entity", "term", (F.col("n_both") >= F.col("n_term")).alias("whole"))


def _places(text: Column, wanted: Column, base: Column) -> Column:
    """``(start, end, whole)`` of every occurrence of a wanted term that meets no base span."""
    words = F.transform(_found(text, TERM), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), wanted[F.lower(w["value"])].alias("whole")))
    item = lambda key, reach, s, whole: F.struct(key.alias("key"), reach.alias("reach"), s["start"].alias("start"), s["end"].alias("end"), whole.alias("whole"))
    terms = F.transform(F.filter(words, lambda w: w["whole"].isNotNull()), lambda w: item(2 * w["end"] - 1, F.lit(0), w, w["whole"]))
    spans = F.transform(base, lambda s: item(2 * s["start"], s["end"], s, F.lit(None).cast("boolean")))

    # in this order the spans before a term are those that start before its end: one of them meets it if their reach does
    def clear(items: Column) -> Column:
        reaches = _running(F.transform(items, lambda x: x["reach"]), F.greatest)
        return _let(reaches, lambda reach: F.filter(items, lambda x, i: x["whole"].isNotNull() & (F.get(reach, i) <= x["start"])))

    kept = _let(F.sort_array(F.concat(terms, spans)), clear)
    return F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["whole"].alias("whole")))


def find_spans(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text, base, terms`` for each document: base spans, and term spans ``(start, end, whole)`` in order.

    A null text is an empty one; repeated rows are documents of their own; an empty table gives no rows;
    extra columns are ignored; a text may hold any number of matches. Rows are numbered when the base spans are
    written, once, with their texts.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = shared.saved(base_spans(slim).withColumn("row", F.monotonically_increasing_id()), "spans")
    # addresses and numbers are spans already: what is left of the text after them holds the terms
    cuts = F.sort_array(F.transform("base", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))))
    rest = F.when(F.size("base") == 0, F.col("text")).otherwise(_replaced(F.col("text"), cuts, lambda c, fresh: F.lit(" ")))
    told = found.withColumn("rest", rest).withColumn("context", F.when(F.size("base") > 0, F.xxhash64("rest")))
    met, hot = mentions(told)
    given = shared.saved(disclosures(told, met), "disclosures")
    mention = _dealt(met.select("row", "entity"), hot).join(_copied(given.select("entity").distinct(), hot), ["entity", "share"])
    # a document's own words meet the terms of its entities, so no pair arises that is not in the text
    held = mention.join(told.where(F.size("base") > 0).select("row", F.array_distinct(_terms(F.col("rest"))).alias("words")), "row").select("row", "entity", "share", F.explode("words").alias("term"))
    wanted = held.join(_copied(given, hot), ["entity", "share", "term"]).groupBy("row", "term").agg(F.min("whole").alias("whole"))
    wanted = wanted.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "whole"))).alias("wanted"))
    joined = found.join(wanted, "row", "left")
    terms = F.when(F.col("wanted").isNotNull(), _places(F.col("text"), F.col("wanted"), F.col("base")))
    return joined.select("row", "doc_id", "text", "base", F.coalesce(terms, F.array().cast("array<struct<start:int,end:int,whole:boolean>>")).alias("terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: base spans replaced by their kind, disclosing terms removed or generalised to ``[TERM]``.

    Where spans overlap the one that starts first (then the longer) is replaced and the others are cut with it.
    """
    cut = lambda s, to: F.struct(s["start"].alias("a"), (-s["end"]).alias("order"), s["end"].alias("b"), to.alias("to"))
    base = F.transform("base", lambda s: cut(s, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    terms = F.transform("terms", lambda s: cut(s, F.when(s["whole"], "").otherwise("[TERM]")))
    say = lambda c, fresh: F.when(fresh, c["to"]).otherwise("")
    return find_spans(docs).select("doc_id", _replaced(F.col("text"), F.sort_array(F.concat(base, terms)), say).alias("text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(shared.table(spark, sf_dir, "documents"))
    text = lambda kind, s: F.concat_ws(":", kind, s["start"], s["end"])
    base = F.transform("base", lambda s: text(s["kind"], s))
    terms = F.transform("terms", lambda s: text(F.lit("term"), s))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))
