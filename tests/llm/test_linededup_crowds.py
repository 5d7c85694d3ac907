"""Bands of more lines than are all compared: what the neighbours miss is found exactly, and every line leaves its chunk."""

import random

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

from awardforge.llm import linededup
from awardforge.llm.lm import packed, unpacked

signed = lambda n: n - 2**64 if n >= 2**63 else n


def template(n, changed, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    frame, out = [word() for _ in range(40)], []
    for k in range(n):
        w = list(frame) if k % 3 else list(out[-1] if out else frame)
        for j in rng.sample(range(40), changed if k % 3 else 1):
            w[j] = word()
        out.append(w)
    return [" ".join(w).encode() for w in out]


def test_crowds_lose_no_alike_pair_of_different_components(spark):
    texts = template(90, 5)
    node = {signed(xxh3_64_intdigest(x)): x for x in texts}
    lines = spark.createDataFrame([(n, bytearray(x)) for n, x in node.items()], "node long, line binary")
    crowded = spark.createDataFrame([(n, 1) for n in node], "node long, key long")
    links = spark.createDataFrame([], "a long, b long")
    got = {(r.a, r.b) for r in linededup._rest_of_crowds(crowded, lines, links).collect()}
    sets = {n: linededup.shingle_sets([x])[0] for n, x in node.items()}
    want = {(a, b) for a in node for b in node if a < b and linededup.alike(sets[a], sets[b])}
    assert got == want and 25 <= len(want) < 2000
    # one component already: nothing is left to find
    chain = list(node)
    whole = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a long, b long")
    assert linededup._rest_of_crowds(crowded, lines, whole).count() == 0


def test_a_crowded_band_is_listed_and_all_its_lines_leave_the_chunk():
    n = linededup.NEAR + 2
    entries = [np.array(x, np.uint64) for x in ([5] * n + [9] * 2, range(n + 2))]
    group = pa.table({"r": [0], "keys": [packed(np.diff(entries[0], prepend=np.uint64(0)))], "nodes": [packed(entries[1])], "marks": [packed(np.zeros(n + 2, np.uint32))], "g": [0]})
    rows = linededup._pair(group).to_pylist()
    assert sorted((r["a"], r["b"]) for r in rows if r["kind"] == 2) == [(k, 5) for k in range(n)]
    texts = template(1, 0) + [template(1, 0)[0] + b" %d" % k for k in range(9)]
    batch = pa.RecordBatch.from_pydict({"text": ["\n".join(x.decode() for x in texts)]})
    out = [row for b in linededup._find(4)(iter([batch])) for row in b.to_pylist()]
    left = np.concatenate([unpacked(r["nodes"], "<u8") for r in out if r["r"] >= 0])
    assert len(left) == len(texts) * linededup.BANDS


def test_sketches_rule_out_no_alike_pair():
    texts = template(60, 4) + [b"abcde", b"abcdef" * 3]
    code, line, n = linededup.distinct_shingles(texts)
    sets = linededup.shingle_sets(texts)
    assert n.tolist() == [len(s) for s in sets]
    for words in (len(linededup.SKETCH), len(linededup.LONG)):
        made = linededup.sketches(code, line, len(n), words).view(np.uint64)
        for a in range(len(texts)):
            for b in range(a):
                assert int(np.bitwise_count(made[a] ^ made[b]).sum()) <= len(sets[a] ^ sets[b])


def test_bands_of_any_size_find_the_same_pairs_and_few_others_are_compared(spark, monkeypatch):
    texts = template(90, 5) + template(90, 30, seed=5)
    node = {signed(xxh3_64_intdigest(x)): x for x in texts}
    lines = spark.createDataFrame([(n, bytearray(x)) for n, x in node.items()], "node long, line binary")
    crowded = spark.createDataFrame([(n, 1) for n in node], "node long, key long")
    none = spark.createDataFrame([], "a long, b long")
    tried = []
    verified = linededup._verified
    monkeypatch.setattr(linededup, "_verified", lambda pairs, rows: tried.append(pairs.count()) or verified(pairs, rows))
    got = []
    for most in (len(node), 10):
        monkeypatch.setattr(linededup, "DIRECT", most)
        got.append({(r.a, r.b) for r in linededup._rest_of_crowds(crowded, lines, none).collect()})
    sets = {n: linededup.shingle_sets([x])[0] for n, x in node.items()}
    want = {(a, b) for a in node for b in node if a < b and linededup.alike(sets[a], sets[b])}
    assert got == [want, want] and max(tried) < 4 * len(want)
