"""The pipeline against a plain version of each stage, and the quality rules against a plain count."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from awardforge.llm import decontam, quality
from awardforge.llm.tokens import public_vocabulary

from .test_decontam import plain
from .test_linededup import brute as brute_lines
from .test_simhash import brute_classes, brute_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    chars = sum(map(len, w))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    rate = lambda a, b: a * 10000 // b if b else 0
    dup = len(lines) - len(set(lines))
    rates = {"symbol_rate": rate(symbols, chars), "dup_line_rate": rate(dup, len(lines)), "repeat_rate": rate(len(covered), len(w)), "long_word_rate": rate(chars, len(w))}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), chars, symbols, dup, len(covered)), rates, failed


def brute_quality(docs):
    """Kept row numbers; each group's limit leans on its language's, and that on the limit of all."""
    read = [(*counts(t), lang or "", source or "") for _, t, lang, source, *_ in docs]
    kept = {k for k, (_, _, failed, *_) in enumerate(read) if not failed}
    for m, least in quality.METRICS.items():

        def sketch(rows):
            values = sorted(quality.GROWTH ** math.ceil(math.log(r[m]) / math.log(quality.GROWTH)) if r[m] > 0 else 0.0 for _, r, failed, *_ in rows if not failed)
            at = lambda q: values[math.ceil(len(values) * q) - 1]
            return len(values), at(quality.EDGE) + quality.SPREADS * max(at(quality.EDGE) - at(quality.CENTRE), least) if values else math.inf

        for k in list(kept):
            _, r, _, lang, source = read[k]
            limit = sketch(read)[1]
            for own in ([x for x in read if x[3] == lang], [x for x in read if x[3:] == (lang, source)]):
                n, mine = sketch(own)
                limit = (n * mine + quality.HALF_WEIGHT * limit) / (n + quality.HALF_WEIGHT)
            if r[m] > limit:
                kept.discard(k)
    return kept


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghiño") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([16, 30])))) for i in range(8)]
    notice = " ".join(say(14))
    docs = []
    for d in range(70):
        lines = [" ".join(say(rng.randint(8, 30))) for _ in range(rng.randint(2, 6))]
        if d % 5 == 0:
            lines.insert(1, notice.title())
        if d % 9 == 0:
            lines.append(rng.choice(items)[1].upper())
        docs.append((d, "\n".join(lines), rng.choice(["en", "es"]), rng.choice(["a", "b", None]), 1))
    docs += [(70, docs[3][1], "en", "a", 1), (71, None, None, None, None), (72, "", "en", "a", 0), (73, "too short", "en", "a", 9), (74, "spam ham " * 40, "en", "a", 1), (75, " ".join(f"{w}###$$$" for w in say(60)), "en", "a", 1), (76, docs[4][1] + " x", "en", "b", 1)]
    return docs, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs, items = corpus()
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_quality_counts(spark, folder):
    docs, _ = corpus()
    rows = {r.doc_id: r for r in quality.op10_quality(spark, folder).collect()}
    kept = brute_quality(docs)
    for k, (d, t, *_) in enumerate(docs):
        r, (n, _, failed) = rows[d], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (*n, failed, k in kept)


def test_run_equals_the_plain_version(spark, folder):
    docs, items = corpus()
    docs = [x for k, x in enumerate(docs) if k in brute_quality(docs)]
    gone, _ = brute_lines(docs)
    docs = [(d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (row, k) not in gone), *rest) for row, (d, t, *rest) in enumerate(docs)]
    classes = brute_classes({d: brute_fingerprint(t, 5) for d, t, *_ in docs})
    docs = [x for x in docs if classes[x[0]] == x[0]]

    def clean(text):
        h = lambda s: np.array([hash(w) for w in plain(s)])
        return not any(decontam.align(h(b), h(text))[0] <= int(0.2 * len(plain(b))) for _, b in items)

    docs = [x for x in docs if clean(x[1])]
    t = Tokenizer.from_file(public_vocabulary())
    want = {d: [*t.encode(text, add_special_tokens=False).ids, 2] for d, text, *_ in docs}
    rows = corpus_pipeline.run(spark, folder).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.start == got.get(r.doc_id, 0) and r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        got[r.doc_id] = r.start + r.length
    assert got == {d: len(x) for d, x in want.items()}


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.op10_quality(spark, str(tmp_path)).count() == 0


def test_extra_columns_of_any_name_pass(spark):
    docs, _ = corpus()
    df = spark.createDataFrame([(d, t, g, s, d) for d, t, g, s, _ in docs], "doc_id long, text string, lang string, source string, n_words long").withColumnRenamed("source", "source")
    out = quality.keep_good(df)
    assert out.columns == df.columns
    assert all(r.n_words == r.doc_id for r in out.collect())
