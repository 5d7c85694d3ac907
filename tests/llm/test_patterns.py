import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from awardforge.llm import patterns, tokens

SCHEMA = "doc_id long, text string, piece string"
PATH = tokens.public_vocabulary("byte_bpe_50k.json")


def test_ids_equal_the_library_on_any_white_space():
    rng, plain, own = random.Random(1), Tokenizer.from_file(PATH), tokens.ByteEncoder(PATH, keep=50)
    parts = ["a", "B", "é", " ", "  ", "\n", "\n\n", " \n", "\t", "'s", "'", "n't", "12", ".", "...", "-", "日本", "😀", "\x1c", "ß", "É", "<|endoftext|>", "<", "|", "\r\n", "\x00", "\x85", "\xa0", " ", "ʼ", "_", "Word", " word,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + ["", " ", "\n", "one two\nthree four."]
    for at in range(0, len(texts), 200):
        some = texts[at : at + 200]
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
        assert own.many([t.encode() for t in some]) == want


def check(rows, docs, size):
    """Every id of every document once, in its place, and sequences without gaps."""
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text, _ in docs:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        n = len(ids)
        cuts = [0, n] if n <= size else [0, *range(n % size or size, n, size), n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_pieces_cover_all_ids_in_sequences_without_gaps(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice(["alpha", "beta,", "Gamma\nDelta", "x"]) for _ in range(rng.choice([0, 1, 10, 60, 300]))), "clash") for k in range(200)]
    docs += [(None, None, None), (3, "", None), (3, "twice", "a"), (3, "twice", "a"), (9, "very long " * 20000, "b")]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    rows = patterns.pack_patterns(df, PATH, size=64).collect()
    n = check(rows, docs, 64)
    total = sum(r.length for r in rows)
    assert n <= 1.02 * -(-total // 64) + 1
    kept = patterns.pack_patterns(df.limit(20), PATH, size=64, keep_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in kept)


def test_empty_table(spark):
    assert patterns.pack_patterns(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_in_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 129, 3000), rng.integers(1, 20, 900), rng.integers(60, 129, 500), np.minimum(rng.geometric(0.03, 2000), 128), np.full(301, 43), rng.integers(1, 129, 7)][seed]
    counts = np.bincount(lengths, minlength=129)
    found = patterns.plan(counts)
    used = Counter()
    for sizes, repeats in found:
        assert sum(sizes) <= 128
        for n in sizes:
            used[n] += repeats
    assert used == Counter(lengths.tolist())
    n, plain = sum(r for _, r in found), sum(r for _, r in patterns.best_fit(counts))
    assert n <= plain + 1 and n >= max(-(-int(lengths.sum()) // 128), int((lengths > 64).sum()))
