import random

from xxhash import xxh3_64_intdigest

from awardforge.llm import linededup
from awardforge.llm.graph import components

SCHEMA = "doc_id long, text string, gone string, n_chars long"


def norm(line):
    return b" ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in line).encode().split())


def shingles(line):
    text = line.decode()
    return frozenset(text[i : i + 5] for i in range(len(text) - 4))


def brute(docs):
    """Rows and lines to drop by comparing all pairs of lines."""
    seen = [(d, r, k, norm(x)) for r, (d, t, *_) in enumerate(docs) for k, x in enumerate((t or "").split("\n")) if norm(x)]
    nodes = sorted({x for *_, x in seen})
    sets = {x: shingles(x) for x in nodes}
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linededup.alike(sets[a], sets[b]):
                links += 1
                parent[find(b)] = find(a)
    first, gone = {}, set()
    for d, r, k, x in sorted(seen, key=lambda s: (s[0] is None, s[0] or 0, s[1], s[2])):
        if first.setdefault(find(x), (r, k)) != (r, k):
            gone.add((r, k))
    return gone, links


def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeéfghi") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 60)))
    common = [line() for _ in range(12)]
    docs = []
    for d in range(90):
        lines = [line() for _ in range(rng.randint(0, 5))] + ["", "short one", "fin", rng.choice(["Глава %d", "Page %d of 90", "第%d章 論語と算盤の話"]) % rng.randrange(40)]
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(common).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([" ", "  "]).join(w).title())
        docs.append((d, "\n".join(lines), "x", 1))
    return docs + [(90, None, "x", 1), (91, "", "x", 1), (3, docs[3][1], "twice", 1), (None, docs[4][1], "no id", 1), (92, "one long line " * 4000, "x", 1)]


def test_lines_dropped_equal_brute_force(spark, tmp_path, monkeypatch):
    docs = corpus()
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    want, links = brute(docs)
    assert links > 20
    got = {(r.row, r.line) for r in linededup.removed_lines(linededup.with_rows(df)).collect()}
    assert len(got ^ want) <= 0.03 * len(want)
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    texts = {(str(r.doc_id), r.gone): r for r in out.collect()}
    for row, (d, t, g, _) in enumerate(docs):
        r = texts[str(d), g]
        if t is None:
            assert r.text is None
        else:
            assert r.text == "\n".join(x for k, x in enumerate(t.split("\n")) if (row, k) not in got)
            assert r.n_chars == (len(r.text) if r.text != t else 1)


def test_chunks_find_each_others_lines(spark, tmp_path, monkeypatch):
    docs = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(8).write.parquet(str(tmp_path / "d"))
    nodes = sorted({norm(x) for _, t, *_ in docs for x in (t or "").split("\n") if norm(x)})
    sets = {xxh3_64_intdigest(x): shingles(x) for x in nodes}
    ids = sorted(sets)
    want = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if linededup.alike(sets[a], sets[b])]
    df = spark.read.parquet(str(tmp_path / "d"))
    for frame in (df.coalesce(1), df):
        links = linededup.line_links(frame).distinct()
        assert all(linededup.alike(sets[r.a & (2**64 - 1)], sets[r.b & (2**64 - 1)]) for r in links.collect())
        got = {n & (2**64 - 1): c for n, c in components(links).collect()}
        assert sum(got.get(a, 0) == got.get(b, 1) for a, b in want) >= 0.97 * len(want)


def test_shingle_sets_are_those_of_the_characters():
    lines = [norm(x) for _, t, *_ in corpus() for x in (t or "").split("\n") if norm(x)][:300]
    found = linededup.shingle_sets(lines) + linededup.shingle_sets([x for x in lines if x.isascii()])
    lines = lines + [x for x in lines if x.isascii()]
    assert [len(x) for x in found] == [len(shingles(x)) for x in lines]
    for a, b, x, y in zip(found, found[9:], lines, lines[9:]):
        assert len(a & b) == len(shingles(x) & shingles(y))


def test_templated_lines_of_a_crowded_band(spark, tmp_path):
    """Thousands of lines of one template over many chunks: similarity 0.5 to 0.75 to each other, some pairs above 0.8."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    frame = [word() for _ in range(60)]

    def line():
        w = list(frame)
        for k in rng.sample(range(60), 9):
            w[k] = word()
        return w

    lines, pairs = [], []
    for _ in range(1200):
        lines.append(line())
    for _ in range(150):
        w = list(rng.choice(lines[:1200]))
        a = " ".join(w)
        w[rng.randrange(60)] = word()
        lines.append(w)
        pairs.append((norm(a), norm(" ".join(w))))
    rng.shuffle(lines)
    docs = [(k, "\n".join(" ".join(w) for w in lines[k::60]), "x", 1) for k in range(60)]
    spark.createDataFrame(docs, SCHEMA).repartition(16).write.parquet(str(tmp_path / "d"))
    links = linededup.line_links(spark.read.parquet(str(tmp_path / "d"))).distinct()
    node = lambda x: xxh3_64_intdigest(x)
    pairs = [(a, b) for a, b in pairs if linededup.alike(shingles(a), shingles(b))]
    assert len(pairs) > 90
    got = {n & (2**64 - 1): c for n, c in components(links).collect()}
    assert sum(got.get(node(a), 0) == got.get(node(b), 1) for a, b in pairs) >= 0.9 * len(pairs)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert linededup.dedup_lines(none).count() == 0
