import random

from awardforge.llm import jaccard, simhash

SCHEMA = "doc_id long, text string"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_classes(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if alike(sets[a], sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def corpus():
    """Texts with near copies on both sides of 0.8, one of them with many copies, and chains whose ends are not alike."""
    rng = random.Random(17)
    words = [f"w{i}" for i in range(2000)]
    docs = []
    for n in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([60, 120, 400]))]
        for _ in range(60 if n == 0 else 6):
            v = list(base)
            for _ in range(rng.randrange(max(2, len(v) // 30))):
                v[rng.randrange(len(v))] = rng.choice(words)
            docs.append(" ".join(v).title())
    step = [rng.choice(words) for _ in range(300)]
    docs += [" ".join(step[12 * k : 12 * k + 180]) for k in range(9)]
    docs += [None, "", "One two", "one TWO", "one two three", "é"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_classes_equal_brute_force_jaccard(spark, tmp_path):
    docs = corpus()
    want = brute_classes(docs)
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert dict(jaccard.near_duplicates(df).collect()) == want
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(want.values()))


def template_pages():
    """Pages of one template with a quarter of their own words, some with an altered copy."""
    rng = random.Random(4)
    template = [f"t{i}" for i in range(120)]
    docs = []
    for i in range(150):
        own = [f"p{i}x{rng.randrange(10**6)}" for _ in range(40)]
        docs.append(" ".join(template + own))
        if i % 10 == 0:
            docs.append(" ".join(template + own[:-1] + ["changed"]))
            docs.append(" ".join(template[3:] + own))
    return list(enumerate(docs))


def test_pages_of_one_template_meet_only_if_alike(spark, tmp_path):
    docs = template_pages()
    want = brute_classes(docs)
    assert len(set(want.values())) == 150
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert dict(jaccard.near_duplicates(df).collect()) == want
    nodes = jaccard.marks(df, 5).selectExpr("node", "n", "node as part")
    pairs = jaccard._meeting(nodes, jaccard._sets(df, 5)).count()
    assert 45 <= pairs < 100  # of 16,110


def test_prefixes_lose_no_alike_pair(spark):
    rng = random.Random(8)
    base = [rng.choice("abc") for _ in range(80)]
    cut = lambda: (lambda at, n: base[at : at + n])(rng.randrange(60), rng.choice([5, 6, 9, 12, 14, 19, 20, 30]))
    docs = [(i, " ".join(cut() + rng.choice([[], [], cut()]))) for i in range(250)]
    df = spark.createDataFrame(docs, SCHEMA)
    sets = jaccard._sets(df, 5).dropDuplicates(["node"])
    node = {r.node: frozenset(r.codes) for r in sets.collect()}
    nodes = sets.selectExpr("node", "cast(size(codes) as long) n", "node as part")
    met = {(r.a, r.b) for r in jaccard._meeting(nodes, sets).collect()}
    want = {(a, b) for a in node for b in node if a < b and 5 * len(node[a] & node[b]) >= 4 * len(node[a] | node[b])}
    assert want and want <= met


def test_a_doc_id_with_several_texts_keeps_one_of_each_class(spark, tmp_path):
    word = lambda k, n=60: [f"{k}x{i}" for i in range(n)]
    a, b, c = word("a"), word("b"), word("c")
    say = " ".join
    rows = [(3, say(a), "x"), (5, say(b), "x"), (5, say(a[:-1]), "y"), (5, say(b[:-1]), "z"), (5, say(c), "x"), (7, say(c[:-1]), "x"), (8, say(word("d")), "x"), (8, say(word("d")).upper(), "x"), (9, None, "x"), (9, None, "x"), (None, say(a), "x")]
    spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(3).write.parquet(str(tmp_path / "d"))
    kept = simhash.keep_one(spark.read.parquet(str(tmp_path / "d")))
    assert kept.dtypes == [("doc_id", "int"), ("text", "string"), ("lang", "string")]
    got = [(r.doc_id, (r.text or "").lower()[:1]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(3, "a"), (5, "b"), (5, "c"), (8, "d"), (9, ""), (None, "a")], key=str)
