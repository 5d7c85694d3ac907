import hashlib
import math
import random
import re
import time

from awardforge.llm import pii

SCHEMA = "doc_id long, text string, base string"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= sum(c.isdigit() for c in v) <= 19 and luhn(v)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= sum(c.isdigit() for c in v) <= 15),
}


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in RULES.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(2)
    bits = ["a@b.co", "x_y@q.org", "@", ".", "-", "_", "é", "𝒳", " ", "\n", "+", "(", ")", "1.2.3.4", "255.255.255.255", "256.1.1.1", "001.2.3.0255", "4111 1111 1111 1111", "4149601755386017", "+44 (0)20 7946-0958", "+1", "12", "7", "0", "a", "Z9", "..", "1.2.3", "a@b", "%"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), "c") for i in range(400)]
    docs += [(900, None, "c"), (901, "a" * 3_000 + "@b.c" + ".d" * 2_000, "c"), (902, "1" * 3_000, "c"), (902, "1" * 3_000, "c"), (None, "x@y.zz", "c"), (903, "+1" + " " * 3_000, "c")]
    got = pii.base_spans(spark.createDataFrame(docs, SCHEMA).drop("base")).collect()
    assert sorted((str(r.doc_id), ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.base)) for r in got) == sorted((str(d), ",".join(brute(t))) for d, t, _ in docs)


def corpus():
    rng = random.Random(3)
    words = [f"{a}{b}ow" for a in "bcdfgh" for b in ("ar", "el", "in")]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, fill(30), "x") for i in range(60)]
    docs += [(100 + i, f"{fill(12)} ask Quillon about mail quillon@corp.example {fill(9)}", "x") for i in range(5)]
    docs += [(200 + i, "same text with Zebrano here joe@copy.example", "x") for i in range(9)]
    return docs + [(300, None, "x")]


def plain_terms(docs):
    """The disclosing words of each document, by counting documents."""
    mentioned, rest = {}, {}
    for d, t, _ in docs:
        spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute(t)))
        cut, at = "", 0
        for a, b, k in spans:
            cut, at = cut + " " + (t[at:a] if a > at else ""), max(at, b)
            value = t[a:b].lower() if k == "email" else t[a:b] if k == "ip" else re.sub("[^0-9]", "", t[a:b])
            mentioned.setdefault(f"{k}:{value}", set()).add(d)
        rest[d] = cut + " " + (t or "")[at:]
    words = {d: [w.lower() for w in re.findall(r"[^\W_]+", r)] for d, r in rest.items()}
    having = {}
    for d, ws in words.items():
        for w in ws:
            having.setdefault(w, set()).add(d)
    out = {}
    for c, ds in mentioned.items():
        for w in {w for d in ds for w in words[d]}:
            both = ds & having[w]
            info = math.log2(len(docs) / len(ds))
            if len(both) * info >= 16 and len({rest[d] for d in both}) >= 3 and math.log2(len(both) * len(docs) / len(ds) / len(having[w])) >= 0.9 * info:
                for d in both:
                    out.setdefault(d, set()).update(v for v in re.findall(r"[^\W_]+", rest[d]) if v.lower() == w)
    return out


def test_terms_that_give_an_entity_away(spark):
    docs = corpus()
    texts = {d: t for d, t, _ in docs}
    df = spark.createDataFrame(docs, SCHEMA)
    rows = pii.find_spans(df).collect()
    assert len(rows) == len(docs)
    found = {(r.doc_id, texts[r.doc_id][s["start"] : s["end"]]) for r in rows for s in r.terms}
    # the name beside the address is found in five surroundings; a copied text is one surrounding; filler says nothing
    assert {(100 + i, "Quillon") for i in range(5)} <= found
    assert not any(d >= 200 or d < 100 for d, _ in found)
    assert not any(w.endswith("ow") for _, w in found)
    assert found == {(d, w) for d, ws in plain_terms(docs).items() for w in ws}
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "Quillon" not in clean[100] and "quillon" not in clean[100] and "[EMAIL]" in clean[100]
    assert clean[0] == texts[0] and clean[300] == ""


def test_query_digests(spark, tmp_path):
    docs = [(1, "mail a@b.co or 1.2.3.4, 4149601755386017, +44 20 7946 0958", "x"), (2, None, "x"), (3, "nothing", "x")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    for d, t, _ in docs:
        r, want = rows[d], brute(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in RULES]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and r.spans == ",".join(want)


def test_empty_table(spark):
    assert pii.find_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digest_is_of_base_spans():
    assert hashlib.sha256(",".join(brute("a@b.c x")).encode()).hexdigest() == hashlib.sha256(b"email:0:5").hexdigest()


def test_a_text_of_twenty_thousand_matches(spark):
    rng = random.Random(5)
    text = " ".join(f"+1 {rng.randint(200, 999)} {rng.randint(1000000, 9999999)}{'é' if i % 7 == 0 else ' ok'}" for i in range(20_000))
    df = spark.createDataFrame([(1, text, "x"), (2, "short", "x")], SCHEMA)
    start = time.time()
    rows = {r.doc_id: r for r in pii.base_spans(df.drop("base")).collect()}
    assert time.time() - start < 5
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in rows[1].base] == brute(text)
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[1] == re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", "[PHONE]", text) and clean[2] == "short"


def test_a_hot_entity_and_overlapping_spans(spark):
    rng = random.Random(6)
    words = [f"{a}{b}um" for a in "bcdfghkl" for b in ("ar", "el", "in", "os")]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, f"{fill(8)} éQuillon quillon@corp.example +1 4149601755386017 {fill(5)} 1.2.3.4@x.org Quillon", "x") for i in range(40)]
    docs += [(100 + i, f"Vendrake {fill(6)} vend@rake.example {fill(3)} VENDRAKE", "x") for i in range(12)] + [(200 + i, fill(20), "x") for i in range(120)]
    texts = {d: t for d, t, _ in docs}
    rows = pii.find_spans(spark.createDataFrame(docs, SCHEMA)).collect()
    found = {(r.doc_id, texts[r.doc_id][s["start"] : s["end"]]) for r in rows for s in r.terms}
    assert {(i, w) for i in range(40) for w in ("éQuillon", "Quillon")} <= found and (100, "VENDRAKE") in found
    assert found == {(d, w) for d, ws in plain_terms(docs).items() for w in ws}
