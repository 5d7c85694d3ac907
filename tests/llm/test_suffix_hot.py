import random

import __spark_entry__

from awardforge.llm import suffix


def covered(texts, least=50):
    """Words of each text that lie in a passage of ``least`` words which another text has too."""
    owners = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - least + 1):
            owners.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - least + 1):
            if len(owners[tuple(w[i : i + least])]) > 1:
                out.setdefault(d, set()).update(range(i, i + least))
    return out


def corpus():
    """Ten texts of 45 words in 40 documents each, of which two also share the 15 words before it, two the 3 before and 3 after, and two are copies."""
    rng = random.Random(23)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(10):
        hot, before, around = say(45), say(15), (say(3), say(3))
        mine = [say(30) + hot + say(60) for _ in range(40)]
        for k in (7, 21):
            mine[k] = say(20) + before + hot + say(60)
        for k in (3, 30):
            mine[k] = say(20) + around[0] + hot + around[1] + say(60)
        mine[11] = list(mine[33])
        texts += mine
    rng.shuffle(texts)
    return texts


def test_words_left_of_a_common_passage_count(spark, tmp_path):
    texts = corpus()
    rows = [(d, " ".join(w)) for d, w in enumerate(texts)]
    spark.createDataFrame(rows, "row long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = {r.row: {x for s in r.spans for x in range(s["first"], s["end"])} for r in suffix.repeated_passages(spark.read.parquet(str(tmp_path / "d"))).collect()}
    want = covered(texts)
    assert len(want) == 60 and got == want


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
