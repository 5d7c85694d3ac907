import random

import numpy as np
from pyspark.sql import functions as F

from awardforge.llm import suffix

SCHEMA = "doc_id long, text string, row string"


def brute(docs, least):
    """Word ranges covered by runs of ``least`` words or more that another document has too."""
    words = [(t or "").lower().split() for _, t, _ in docs]
    where = {}
    for r, w in enumerate(words):
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), set()).add(r)
    out = {}
    for r, w in enumerate(words):
        covered = set()
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                covered.update(range(i, i + least))
        spans = []
        for x in sorted(covered):
            if spans and spans[-1][1] == x:
                spans[-1][1] = x + 1
            else:
                spans.append([x, x + 1])
        if spans:
            out[r] = [tuple(s) for s in spans]
    return out


def test_passages_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [say(n) for n in (49, 50, 51, 70, 130, 300)]
    docs = []
    for d in range(80):
        text = say(rng.choice([0, 20, 120, 400]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            p, at = rng.choice(shared), rng.randrange(len(text) + 1)
            a = rng.choice([0, 0, 10])
            text[at:at] = p[a:]
        docs.append((d, " \n".join(text).title(), "clash"))
    inside = say(60)
    docs += [(80, None, "c"), (81, docs[3][1], "copy"), (3, docs[3][1], "again"), (82, " ".join(say(5) + inside + say(9) + inside), "within"), (None, docs[5][1], "no id")]
    df = spark.createDataFrame(docs, SCHEMA).coalesce(1).select(F.monotonically_increasing_id().alias("row"), "text")
    df.write.parquet(str(tmp_path / "d"))
    got = {r.row: [(s["first"], s["end"]) for s in r.spans] for r in suffix.repeated_passages(spark.read.parquet(str(tmp_path / "d")).coalesce(1)).collect()}
    want = brute(docs, 50)
    assert got.keys() == want.keys()
    cover = lambda spans: {x for a, b in spans for x in range(a, b)}
    assert sum(len(cover(got[r]) ^ cover(want[r])) for r in want) <= 0.01 * sum(len(cover(want[r])) for r in want)


def test_minimisers_and_empty_table(spark):
    code = np.random.default_rng(0).integers(0, 50, 400).astype(np.uint64)
    want = sorted({i + int(np.argmin(code[i : i + 7])) for i in range(394)})
    assert suffix.minimisers(code, 7).tolist() == want
    assert suffix.repeated_passages(spark.createDataFrame([], "row long, text string")).count() == 0
