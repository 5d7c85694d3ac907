import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from awardforge.llm import lm

SCHEMA = "doc_id long, text string, score string"


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


def grams(t, order):
    """Each token with its contexts, the longest first; the document's start is a word of its own."""
    seen = ["^"] + t
    for i in range(1, len(seen)):
        yield [(tuple(seen[max(0, i - k + 1) : i]), seen[i]) for k in range(min(order, i + 1), 0, -1)]


def brute(docs, order=2):
    train = [tokens(t) for d, t, _ in docs if zlib.crc32(b"" if d is None else str(d).encode()) % 10]
    count = Counter(g for t in train for gs in grams(t, order) for g in gs)
    ctx = Counter()
    for (h, w), c in count.items():
        ctx[h] += c
    uni = {w: c for (h, w), c in count.items() if not h}
    n, v = sum(uni.values()), len(uni)
    once, twice = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    disc = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    tot, new = Counter(), Counter()
    for (h, w), c in count.items():
        if h and ctx[h] > 1:
            b = len(h), int(math.log2(ctx[h] - 1))
            tot[b] += c
            new[b] += c == 1

    def p(h, w):
        if not h:
            return (uni[w] - disc if w in uni else disc * v) / n
        shorter = p(h[1:], w)
        if not ctx[h]:
            return shorter
        b = len(h), int(math.log2(ctx[h]))
        b = min(max((new[b] + 1) / (tot[b] + 2), 1e-4), 1 - 1e-4)
        return (1 - b) * count[h, w] / ctx[h] + b * shorter

    out = []
    for d, t, _ in docs:
        t = tokens(t)
        out.append((str(d), len(t), sum(w in uni for w in t), n, sum(math.log10((uni.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t), sum(math.log10(p(*gs[0])) for gs in grams(t, order))))
    return out, p, uni, ctx


def corpus():
    rng = random.Random(4)
    words = [f"Wörd{int(rng.paretovariate(0.7))}" for _ in range(150)] + ["THE", "the", "of"]
    docs = [(i, " \t".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 200]))), "x") for i in range(120)]
    return docs + [(120, None, None), (5, docs[5][1], "twice"), (None, "the of", "no id")]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_brute_force(spark, tmp_path, order):
    docs = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    got = lm.score_documents(spark.read.parquet(str(tmp_path / "d")), order, chunk_bytes=4000).collect()
    want, p, uni, ctx = brute(docs, order)
    key = lambda r: (r[0], r[1], r[2], round(r[4], 6))
    got = sorted([(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)
    # a state's arcs and its failure arc sum to one over the known words and the unknown class
    for h in [(), ("^",), (b"the",), (b"of", b"the"), (b"never seen",)]:
        if len(h) < order:
            assert abs(sum(p(h, w) for w in uni) + p(h, "unknown") - 1) < 1e-9


def test_a_very_long_text_and_an_empty_table(spark, tmp_path):
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = random.Random(7)
    long = " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(200_000))
    docs = [(1, long, "x"), (2, "w1 w2", "x"), (10, "w1 unseen w1", "x")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in lm.score_documents(spark.read.parquet(str(tmp_path / "d")), chunk_bytes=100_000).collect()}
    want = brute(docs, 3)[0]
    for d, n, known, _, base, score in want:
        assert (got[int(d)].n_tokens, got[int(d)].n_known) == (n, known)
        assert np.allclose([got[int(d)].base_score, got[int(d)].score], [base, score])


def test_no_training_rows(spark, tmp_path):
    held = next(i for i in range(100) if lm.held_out(i))
    rows = lm.score_documents(spark.createDataFrame([(held, "a b", "x")], SCHEMA)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(True, 3, 0, 0)]
    assert math.isfinite(rows[0].score)


def test_packed_numbers():
    for x in (np.array([], "<u8"), np.array([1, 2**60, 5], "<u8"), np.arange(5, dtype="<u4")):
        assert lm.unpacked(lm.packed(x), x.dtype.str).tolist() == x.tolist()


FRESH = """
import sys, tempfile
from pyspark.sql import SparkSession
from awardforge.llm import lm
spark = SparkSession.builder.master("local[2]").config("spark.python.worker.reuse", "false").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", tempfile.mkdtemp(dir=sys.argv[1])).getOrCreate()
rows = lm.score_documents(spark.createDataFrame([(i, "a b a c", "x") for i in range(20)], "doc_id long, text string, score string")).collect()
assert len(rows) == 20 and all(r.score < 0 for r in rows)
spark.stop()
"""


def test_in_new_workers(tmp_path):
    """Each task in a worker of its own, so that nothing an earlier task imported is there."""
    subprocess.run([sys.executable, "-c", FRESH, str(tmp_path)], check=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def test_arcs_are_ordered_by_state_and_word():
    rng = np.random.default_rng(5)
    pairs = rng.permutation(np.unique(rng.integers(0, [40, 2**31], (5000, 2)), axis=0))
    pairs[:50, 0] += 2**31 - 100
    assert (lm.arc_order(pairs[:, 0], pairs[:, 1]) == np.lexsort((pairs[:, 1], pairs[:, 0]))).all()
