import random

from awardforge.llm import decontam

SCHEMA = "doc_id long, text string, item_id string"


def build():
    rng = random.Random(8)
    words = [f"wörd{i}" for i in range(400)] + ["the", "of", "and"] * 40
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, say(rng.choice([6, 15, 30, 57]))) for i in range(30)]
    docs, want = [], set()
    for d in range(120):
        text = say(rng.choice([10, 200, 800]))
        if d % 3 == 0:
            k, item = rng.choice(items)
            passage = list(item)
            for _ in range(int(0.2 * len(item)) if d % 2 else 0):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], [rng.choice(words)], [passage[at], rng.choice(words)]])
            at = rng.randrange(len(text))
            text[at:at] = passage
            want.add((d, k))
        docs.append((d, ", ".join(text[:5]).upper() + ". " + "\n".join(text[5:]), "clash"))
    bench = [(i, " ".join(w).title() + "!") for i, w in items]
    return docs, bench, want


def plain(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def test_all_passages_within_the_limit_are_found(spark):
    docs, bench, want = build()
    df, items = spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(bench, "item_id long, text string")
    rows = decontam.find_passages(df, items).collect()
    truth = set()
    for d, t, _ in docs:
        for i, b in bench:
            item, text = plain(b), plain(t)
            if decontam.align(*(__import__("numpy").array([hash(w) for w in x]) for x in (item, text)))[0] <= int(0.2 * len(item)):
                truth.add((d, i))
    assert want <= truth | want
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= truth
    assert len(got) >= 0.97 * len(truth)
    texts = {d: t for d, t, _ in docs}
    for r in rows:
        if r.distance == 0:
            assert plain(texts[r.doc_id][r.start : r.end]) == plain(dict(bench)[r.item_id])
    kept = decontam.drop_contaminated(df, items)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, _ in docs} - {d for d, _ in got}


def test_edge_rows(spark):
    docs = [(1, None, None), (2, "", None), (None, "one two three four five", None), (3, "one two three four five", None), (3, "one two three four five", None), (4, "x " * 30000, None)]
    df = spark.createDataFrame(docs, SCHEMA)
    items = spark.createDataFrame([(7, "One, two; three four five"), (8, None), (9, "!!"), (10, "one two three four five")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontam.find_passages(df, items).collect())
    assert got == [("3", 7), ("3", 7), ("3", 10), ("3", 10), ("None", 7), ("None", 10)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_passages(df, none).count() == 0 and decontam.drop_contaminated(df, none).count() == 6
    assert decontam.find_passages(df.limit(0), items).count() == 0
