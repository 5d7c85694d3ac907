import random

from xxhash import xxh64_intdigest

from awardforge.llm import graph, simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_fingerprint(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs, k = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 60, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            v = list(base)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = rng.choice(words)
            docs.append((k, "  ".join(v).title(), "clash"))
            k += 1
    docs += [(k, None, None), (k + 1, "", None), (k + 2, "é", None), (k + 3, "One two", "x"), (k + 4, "one TWO", "y")]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = {d: brute_fingerprint(t, 3) for d, t, _ in docs}
    assert {d: r.fp & (2**64 - 1) for d, r in got.items()} == fps
    assert {d: r.component_id for d, r in got.items()} == brute_classes(fps)


def test_links_survive_tree_splitting(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 120:
        x = rng.choice(sorted(fps))
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [(x - 2**64 if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    for limit in (7, 1000):
        got = {(min(a, b), max(a, b)) for a, b in simhash.near_links(df, tree_limit=limit).collect()}
        assert got == want


def test_empty_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d", None), (1, "a b c d", None), (None, "a b c d", None), (2, "a b c d", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 1)] * 3 + [(True, 1)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(200)] + [(500 + i, 900 - i) for i in range(150)] + [(7, 7), (None, 3)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect())
    assert all(got[i] == 0 for i in range(201))
    assert all(got[500 + i] == 500 + i == got[900 - i] for i in range(150))
