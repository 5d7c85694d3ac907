import random

import duckdb

from awardforge.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long"


def rows(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    return sorted(tuple(r) for r in divergence.divergences(df.repartition(3)).select("lang", "source", "part", "item", "value", "rank").collect())


def oracle(docs):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n BIGINT)")
    if docs:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", docs)
    return sorted(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.ORACLE})").fetchall())


def made():
    rng = random.Random(4)
    words = ["The", "the,", "(the)", "fox", "Fox-trot", "é", "Été.", "日本", "a1b", "42", "--", "don't", "x\x00y", "rare" + "z"]
    docs = []
    for k in range(80):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(rng.choice([0, 3, 30, 120])))
        docs.append((k, text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"]), 0))
    # one document with all spellings of a word, and a word of exactly two and of exactly three documents
    docs += [(1, "solo, Solo solo. (solo)", "en", "a", 1), (2, "duo Duo, duo!", "en", "a", 1), (2, "duo, DUO", "en", "a", 1)]
    docs += [(None, "trio", "en", "a", 1), (None, "Trio.", "en", "b", 1), (None, "(trio) trio", "en", "b", 1)]
    docs += [(9, "only here", "xx", "one", 0), (9, "", "xx", "two", 0), (9, None, None, None, None), (7, "fox " * 50000 + "the", "en", "long", 0)]
    return docs


def test_equal_to_sql_with_nulls_spellings_and_groups_without_terms(spark):
    docs = made()
    assert rows(spark, docs) == oracle(docs)


def test_short_stretches_and_blocks_change_nothing(spark, monkeypatch):
    docs = made()
    want = oracle(docs)
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 5)
    assert rows(spark, docs) == want


def test_empty_table(spark):
    assert rows(spark, []) == []
