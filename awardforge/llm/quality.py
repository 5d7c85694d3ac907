"""Quality rules with adaptive thresholds: DataFrame functions only.

Each language and source gets its own limits from quantile sketches instead of fixed cutoffs. A sketch
is a histogram over logarithmic buckets (bucket k holds values in (g^(k-1), g^k], so a quantile is
known to a relative error of g - 1). Two sketches merge by adding counts, which is what a partial
aggregation does, so a hot source costs no more than a cold one and the result does not depend on
the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SYMBOLS = "#*$%&|<>"
WINDOW = 8
GROWTH = 1.02

#: Metric, and the least distance between centre and edge (parts in ten thousand) that counts as spread: where nearly all
#: documents of a group have the same value, quantiles alone would refuse the first one that differs.
METRICS = {
    "symbol_rate": 50,
    "dup_line_rate": 750,
    "repeat_rate": 400,
    "long_word_rate": 2500,
}
#: A source of this many documents is judged half by its own sketch and half by its language's, which leans on all in the same way.
HALF_WEIGHT = 200
CENTRE, EDGE, SPREADS = 0.5, 0.9, 4.0


def word_array(text: Column) -> Column:
    """Words of a text: a leading or trailing gap gives an empty piece, which is dropped."""
    return F.array_remove(F.split(text, shared.SPACE_CLASS + "+"), "")


def repeated_words(df: DataFrame) -> DataFrame:
    """``df`` with n_repeat_words from its ``_words``: words that lie in a ``WINDOW``-word window found twice or more in the text, the first finding included.

    A lambda computes anew whatever it takes from outside, so each array is a column of its own first,
    and neighbours of the sorted windows are compared by zipping the array with itself moved by one.
    """
    n, none = F.size("_words"), F.array().cast("array<int>")
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at("_words", i + k) for k in range(WINDOW)]))
    df = df.withColumn("_windows", F.when(n > WINDOW, hashes))
    order = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_order", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), order))
    moved = F.slice("_order", 2, F.greatest(F.size("_order"), F.lit(1)))
    pairs = F.zip_with("_order", moved, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(none))
    df = df.withColumn("_at", F.when(F.col("_order").isNotNull(), F.sort_array(F.array_distinct(F.flatten(pairs)))))
    state = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate("_at", state, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")), lambda s: s["n"])
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_windows", "_order", "_at")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    solid = F.filter(F.split(text, "\n"), lambda line: F.trim(F.translate(line, shared.SPACE, "")) != "")
    out = docs.withColumn("_words", word_array(text)).withColumn("_lines", solid)
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(text, shared.SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        }
    )
    out = repeated_words(out).drop("_words", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _rates(df: DataFrame) -> dict[str, Column]:
    """Metrics as whole parts in ten thousand, so that sums and buckets are exact."""
    part = lambda a, b: F.coalesce(F.expr(f"cast(({a}) * 10000 div nullif({b}, 0) as long)"), F.lit(0).cast("long"))
    return {
        "symbol_rate": part("n_symbols", "word_chars"),
        "dup_line_rate": part("n_dup_lines", "n_lines"),
        "repeat_rate": part("n_repeat_words", "n_words"),
        "long_word_rate": part("word_chars", "n_words"),
    }


def sketches(rated: DataFrame) -> DataFrame:
    """Histogram counts: one row for each language, source, metric and bucket."""
    long = rated.select(F.col("_lang"), F.col("_source"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])).alias("m"))
    bucket = F.when(F.col("m.x") <= 0, -1).otherwise(F.ceil(F.log(F.col("m.x").cast("double")) / F.log(F.lit(GROWTH)))).cast("int")
    return long.groupBy("_lang", "_source", F.col("m.metric").alias("metric"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def limits(sketch: DataFrame) -> DataFrame:
    """The limit of each metric for each language and source that the sketches know."""
    merged = sketch.select("_lang", "_source", "metric", "bucket", "n")
    least = F.create_map(*[x for m, v in METRICS.items() for x in (F.lit(m), F.lit(float(v)))])
    levels = [("source", ["_lang", "_source"]), ("lang", ["_lang"]), ("all", [])]
    keys = merged.select("_lang", "_source", "metric").distinct()
    for name, by in levels:
        total = merged.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "metric")
        ranked = total.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        value = F.when(F.col("bucket") < 0, 0.0).otherwise(F.pow(F.lit(GROWTH), F.col("bucket").cast("double")))
        at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), value))
        quantiles = ranked.groupBy(*by, "metric").agg(F.first("total").alias(f"n_{name}"), at(CENTRE).alias("mid"), at(EDGE).alias("edge"))
        spread = F.greatest(F.col("edge") - F.col("mid"), least[F.col("metric")])
        quantiles = quantiles.withColumn(f"limit_{name}", F.col("edge") + SPREADS * spread).drop("mid", "edge")
        keys = keys.join(quantiles, [*by, "metric"], "left")
    # a small group leans on the next wider one, the more the smaller it is
    limit = F.col("limit_all")
    for name in ("lang", "source"):
        limit = (F.col(f"n_{name}") * F.col(f"limit_{name}") + HALF_WEIGHT * limit) / (F.col(f"n_{name}") + HALF_WEIGHT)
    keys = keys.withColumn("limit", limit)
    return keys.groupBy("_lang", "_source").agg(*[F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(f"{m}_limit") for m in METRICS])


def rated(docs: DataFrame) -> DataFrame:
    """The counts and rates of each document beside its whole row as the struct ``_row``."""
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"), group("lang").alias("_lang"), group("source").alias("_source"))
    counts = measured(plain).drop("text")
    return counts.withColumns(_rates(counts))


def verdict(counts: DataFrame) -> DataFrame:
    """``counts`` with the limits that apply and ``kept``."""
    found = limits(sketches(counts.where(~F.col("base_failed"))))
    fits = F.lit(True)
    for m in METRICS:
        fits = fits & (F.col(m) <= F.coalesce(F.col(f"{m}_limit"), F.lit(float("inf"))))
    return counts.join(found, ["_lang", "_source"], "left").withColumn("kept", ~F.col("base_failed") & fits)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, all their columns as they were.

    A null text is an empty one and fails (fewer than 20 words); a null language or source is a group of
    its own; repeated rows each count and each get a verdict; an empty table gives no rows; columns of
    any name pass through, as each row travels as one struct. The counts are written before they are
    filtered on: a filter pushed into them would compute their arrays anew inside each lambda.
    """
    return verdict(shared.saved(rated(docs), "quality")).where("kept").select("_row.*")


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. The counts are taken once and kept in the shared folder: sketches and verdict both read them."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counts = rated(docs).withColumn("_row", F.struct("_row.doc_id"))
    return verdict(shared.saved(counts, "quality")).select("_row.doc_id", *RESULT)


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_WORDS} AS w, {_LINES} AS l, coalesce(text, '') AS t FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
dup AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, i - coalesce(p, i - 8))) AS n FROM dup GROUP BY doc_id),
base AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
rated AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    coalesce(n_symbols * 10000 // nullif(word_chars, 0), 0) AS symbol_rate, coalesce(n_dup_lines * 10000 // nullif(n_lines, 0), 0) AS dup_line_rate,
    coalesce(n_repeat_words * 10000 // nullif(n_words, 0), 0) AS repeat_rate, coalesce(word_chars * 10000 // nullif(n_words, 0), 0) AS long_word_rate
  FROM base),
long AS (
  SELECT lang, source, metric, CASE WHEN x <= 0 THEN -1 ELSE CAST(ceil(ln(x) / ln({GROWTH}::DOUBLE)) AS INTEGER) END AS bucket
  FROM (UNPIVOT (SELECT lang, source, symbol_rate, dup_line_rate, repeat_rate, long_word_rate FROM rated WHERE NOT base_failed)
        ON symbol_rate, dup_line_rate, repeat_rate, long_word_rate INTO NAME metric VALUE x)),
sk AS (SELECT lang, source, metric, bucket, count(*) AS n FROM long GROUP BY ALL),
lv AS (
  SELECT 0 AS lv, lang, source, metric, bucket, n FROM sk
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM sk GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM sk GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, metric) AS total,
    CASE WHEN bucket < 0 THEN 0.0::DOUBLE ELSE pow({GROWTH}::DOUBLE, bucket) END AS v FROM lv),
qs AS (SELECT lv, lang, source, metric, any_value(total) AS total, min(CASE WHEN upto >= ceil(total * {CENTRE}::DOUBLE) THEN v END) AS mid,
    min(CASE WHEN upto >= ceil(total * {EDGE}::DOUBLE) THEN v END) AS edge FROM cum GROUP BY ALL),
lim AS (SELECT lv, lang, source, metric, CAST(total AS DOUBLE) AS total, edge + {SPREADS}::DOUBLE * greatest(edge - mid, CASE metric {" ".join(f"WHEN '{m}' THEN {v}::DOUBLE" for m, v in METRICS.items())} END) AS lim FROM qs),
chosen AS (
  SELECT a.lang, a.source, a.metric, (a.total * a.lim + {HALF_WEIGHT} * ((b.total * b.lim + {HALF_WEIGHT} * c.lim) / (b.total + {HALF_WEIGHT}))) / (a.total + {HALF_WEIGHT}) AS lim
  FROM lim a JOIN lim b ON b.lv = 1 AND a.lang = b.lang AND a.metric = b.metric JOIN lim c ON c.lv = 2 AND a.metric = c.metric WHERE a.lv = 0),
wide AS (SELECT lang, source, {", ".join(f"max(lim) FILTER (metric = '{m}') AS {m}_limit" for m in METRICS)} FROM chosen GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed {"".join(f" AND {m} <= coalesce({m}_limit, 'infinity'::DOUBLE)" for m in METRICS)}) AS kept
FROM rated LEFT JOIN wide USING (lang, source)
"""
