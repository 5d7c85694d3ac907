import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from awardforge.llm import packing, repair, shared
from awardforge.llm.tokens import WordEncoder, public_vocabulary

ODD = ["a b  c", "x\x1cy z", "don't DON'T it's ½ é É", "<|endoftext|>hi <|startoftext|> <| endoftext", "İstanbul ǅ ſ", "日本語 テスト１２", "a b　c", "́abc x́", "'s 't a's2b", "", "\x85a\x85b", "THE!! the,the a1b2", "ß ÿ× ÷ Ñandú", "!"]
SCHEMA = "doc_id long, text string, start string"


def direct(text):
    t = Tokenizer.from_file(public_vocabulary())
    return t.encode(text or "", add_special_tokens=False).ids


def test_words_encode_as_whole_texts():
    enc = WordEncoder(public_vocabulary(), keep=5)
    for text in ODD * 2:
        assert np.frombuffer(enc.ids(text.encode()), "<u4").tolist() == direct(text)


def corpus():
    rng = random.Random(1)
    words = ["the", "lease", "of", "Señor", "x1", "ending.", "!!"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 700])))) for i in range(60)]
    return [(i, t, "z") for i, t in docs] + [(60, None, None), (61, "word " * 9000, "z"), (7, "again", "z"), (None, "no id", "z")]


def test_grammar_round_trip(spark, tmp_path):
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    repair.write_corpus(df, str(tmp_path / "g"), public_vocabulary(), shard_tokens=3000)
    rows = repair.read_corpus(spark, str(tmp_path / "g")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((d for d, _, _ in docs), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    want = sorted((str(d), zlib.crc32(np.array(direct(t) + [1], "<u4").tobytes())) for d, t, _ in docs)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in rows) == want
    files = [r.asDict() for r in spark.read.parquet(str(tmp_path / "g")).collect()]
    assert sum(len(f["rules"]) for f in files) > 0
    texts = {d: t for d, t, _ in docs[:60] if d != 7}
    for f in files:
        for k, d in enumerate(f["doc_ids"]):
            if d in texts:
                assert repair.document_ids(f, k).tolist() == direct(texts[d]) + [1]


@pytest.mark.parametrize("n", [0, 1, 2, 500, 5000])
def test_expand_undoes_compress(n):
    ids = np.random.default_rng(n).integers(0, 6, n).astype(np.uint32)
    seq, rules = repair.compress(ids, 1, 10, least=2)
    assert repair.expand(seq, rules, repair.rule_lengths(rules, 10), 10).tolist() == ids.tolist()
    assert not (rules == 1).any()


def test_every_id_lies_in_one_piece(spark):
    docs = corpus()
    size = 512
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    rows = packing.pack_documents(df, public_vocabulary(), size=size, waste=4).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    ids = {(str(d), len(x)): x for d, t, _ in docs for x in [direct(t) + [2]]}
    assert by_doc.keys() == ids.keys()
    for key, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[key][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == key[1]
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding < 0.02 * sum(r.length for r in rows)


def test_best_fit_matches_plain_search():
    rng = random.Random(2)
    lengths = [rng.randint(1, 64) for _ in range(300)]
    windows, room = [], []
    for p in sorted(range(300), key=lambda k: (-lengths[k], k)):
        fits = [w for w in range(len(windows)) if room[w] >= lengths[p]]
        if fits:
            w = min(fits, key=lambda w: room[w])
        else:
            w = len(windows)
            windows.append([])
            room.append(64)
        windows[w].append(p)
        room[w] -= lengths[p]
    got = packing.best_fit_decreasing(lengths, 64)
    assert sorted(p for w in got for p in w) == list(range(300))
    assert sorted(sum(lengths[p] for p in w) for w in got) == sorted(64 - r for r in room)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(none, public_vocabulary()).count() == 0
    repair.write_corpus(none, str(tmp_path / "e"), public_vocabulary())
    assert repair.read_corpus(spark, str(tmp_path / "e")).count() == 0


def test_word_spans_and_hashes():
    import pyarrow as pa

    texts = ["Ab  c", None, "", "é\tAB\nab", " x"]
    data, offsets = shared.text_buffer(pa.array(texts, pa.string()))
    low, a, b, first = shared.words(data, offsets)
    assert [low[i:j].tobytes() for i, j in zip(a, b)] == [b"ab", b"c", "é".encode(), b"ab", b"ab", b"x"]
    assert first.tolist() == [0, 2, 2, 2, 5, 6]
    h = shared.span_hashes(low, a, b)
    assert h[0] == h[3] == h[4] and len(set(h.tolist())) == 4
