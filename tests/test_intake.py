"""Title links, privacy and parts of a price cell against plain versions."""

import datetime as dt
import random

import numpy as np

from pyspark.sql import functions as F

from awardforge.functions import privacy
from awardforge.operators import linking, pricing

DAY = dt.date


def titles(rng, n):
    words = ["cyber", "security", "cybersecurity", "service", "services", "network", "networks", "operation", "operations", "help", "desk"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_similarities_equal_single_pairs():
    rng = random.Random(3)
    a = titles(rng, 40) + ["", "日本 network", "x" * 90, "ñandú services"]
    found = linking.similarities(a, a[::-1])
    for i, x in enumerate(a):
        for j, y in enumerate(a[::-1]):
            assert abs(found[i, j] - linking.token_sort_similarity(x, y)) < 1e-9


def plain_links(cands, notices):
    """The best notice of each candidate by comparing all pairs."""
    month = lambda d, k: None if d is None else dt.date(d.year + (d.month - 1 + k) // 12, (d.month - 1 + k) % 12 + 1, min(d.day, 28))
    out = {}
    for c in cands:
        best, late_seen, origin_seen = None, False, False
        for n in notices:
            ids = {"".join(ch for ch in (x or "") if ch.isalnum()).upper() for x in (c["piid"], c["parent_idv"])} - {""}
            by_id = "".join(ch for ch in n["solicitation_number"] or "" if ch.isalnum()).upper() in ids
            sim = linking.token_sort_similarity(c["title"], n["title"]) if c["title"].strip() and n["title"].strip() else 0.0
            flags = (c["naics"] == n["naics"]) * 15 + (c["agency"] == n["agency"]) * 10 + (c["state"] == n["state"]) * 8
            kind = "High" if by_id else "Medium" if sim >= 70 else "Low" if sim >= 55 and flags else None
            if not kind:
                continue
            posted, ends = n["posted_date"], (c["expiry"], c["current_end"])
            if posted < c["pop_start"]:
                origin_seen = True
                continue
            if any(ends) and not any(e and month(e, -24) <= posted <= month(e, 12) for e in ends):
                late_seen = True
                continue
            rank = (100 if by_id else 0) + (sim / 5 if sim >= 70 else 0 if by_id else sim / 10) + flags
            if best is None or (-rank, n["notice_id"]) < best[0]:
                best = ((-rank, n["notice_id"]), kind)
        reason = "linked" if best else "outside both windows" if late_seen else "posted before the award began" if origin_seen else "no establishing match"
        out[c["candidate_id"]] = (best[0][1] if best else None, best[1] if best else "No Match", reason)
    return out


def test_links_by_title_equal_all_pairs(spark):
    rng = random.Random(5)
    day = lambda: DAY(1990 + rng.randrange(12), rng.randint(1, 12), rng.randint(1, 28))
    cands = [dict(candidate_id=f"c{k:03}", piid=f"W-{k}", parent_idv=rng.choice([None, "IDV9"]), title=t, naics=rng.choice("ab"), agency=rng.choice("xy"), state=rng.choice(["VA", "MD"]), pop_start=day(), expiry=rng.choice([None, day()]), current_end=day()) for k, t in enumerate(titles(rng, 60) + ["", " "])]
    notices = [dict(notice_id=f"n{k:03}", notice_type="t", solicitation_number=rng.choice(["w 7", "sol", None, f"W{k}"]), title=t, posted_date=day(), naics=rng.choice("ab"), agency=rng.choice("xy"), state=rng.choice(["va", "MD"])) for k, t in enumerate(titles(rng, 50) + [""])]
    c = spark.createDataFrame(cands, "candidate_id string, piid string, parent_idv string, title string, naics string, agency string, state string, pop_start date, expiry date, current_end date")
    n = spark.createDataFrame(notices, "notice_id string, notice_type string, solicitation_number string, title string, posted_date date, naics string, agency string, state string")
    for x in notices:
        x["state"] = x["state"].upper()
    got = {r.candidate_id: (r.notice_id, r.link_confidence, r.link_reason) for r in linking.links(c, n).collect()}
    assert got == plain_links(cands, notices)
    assert {v[1] for v in got.values()} >= {"High", "Medium", "No Match"}


def plain_comparables(rows, rates):
    """The ladder by looking at every pair."""
    out = []
    for c in rows:
        own, found = rates[c["award_id"]], []
        for p in rows:
            rate = rates[p["award_id"]]
            if p is c or rate is None or p["psc"][:2] != c["psc"][:2]:
                continue
            fits = own is None or (rate * 4 >= own and rate <= 4 * own)
            same = fits and p["signed"] >= DAY(1995, 1, 1) and p["naics"] == c["naics"]
            rung = 1 if same and p["component"] == c["component"] else 2 if same else 3 if fits else 4
            found.append((rung, -p["signed"].toordinal(), p["award_id"]))
        rung = next((k for k in (1, 2, 3, 4) if sum(f[0] <= k for f in found) >= 5), None)
        if rung:
            out += [(c["candidate_id"], "ABCD"[rung - 1], a, "ABCD"[r - 1]) for r, _, a in sorted(f for f in found if f[0] <= rung)[:40]]
    return sorted(out)


def test_comparables_equal_the_whole_ladder_and_parts_change_nothing(spark):
    rng = random.Random(8)
    start = DAY(1993, 1, 1)
    rows = [dict(award_id=f"a{k:04}", candidate_id=f"RC-a{k:04}", naics=rng.choice(["541512", "541511"]), psc=rng.choice(["D302", "D307", "R425"]), component=rng.choice("mn"), award_type="BPA CALL", value=float(rng.choice([0, *range(1, 10)]) * 10 ** rng.randint(3, 7)), pop_start=start, current_end=start + dt.timedelta(rng.randint(100, 1500)), signed=start + dt.timedelta(rng.randint(0, 1800)), pricing_code=rng.choice("JUY1")) for k in range(170)]
    df = spark.createDataFrame(rows).withColumn("value", F.col("value").cast("decimal(18,2)"))
    rates = {r.award_id: r.rate for r in df.select("award_id", pricing.run_rate().alias("rate")).collect()}
    whole, cut = (sorted(tuple(r)[:4] for r in pricing.comparables(df, df, part=p).select("candidate_id", "rung", "comp_id", "own_rung").collect()) for p in (10**6, 7))
    assert whole == cut == plain_comparables(rows, rates) and {r[1] for r in whole} >= {"A", "B", "C"}


def test_orders_over_time_from_a_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 200):
        rank = rng.permutation(n)
        levels = pricing._wavelet(rank)
        upto, bound = rng.integers(0, n + 1, 300), rng.integers(0, n + 1, 300)
        assert pricing._below(levels, upto, bound).tolist() == [int((rank[:u] < b).sum()) for u, b in zip(upto, bound)]
        some = upto[upto > 0]
        place = rng.integers(0, some)
        assert pricing._nth(levels, some, place).tolist() == [int(np.sort(rank[:u])[k]) for u, k in zip(some, place)]


def test_titles_that_name_a_person(spark):
    named = ["Poc - Q Tester", "(attn) : Placeholder", "CS: Tester", "PKF Dummyname/Fillin", "Base/PK Fillin", "PKB - Dummy - Fillin", "Dummy-Fillin-PHK order", "CMK, Tester", "n102d bench", "Contracting officer's: Tester", "POC is Tester", "Dummy:Fillin desks", "PK: Tester"]
    plain = ["Co-locate racks", "Trial of concept (POC)", "17 CS", "PKA/WING audit", "PKP FY24", "PKG of ten", "PKB radios", "IGF:OT x", "N1021 cable", "Note: parts", "PK: PZ study", "", None]
    df = spark.createDataFrame([(t,) for t in named + plain], "title string")
    out = [r.title for r in privacy.withhold_titles(df, ("title", "absent")).collect()]
    assert out == [privacy.WITHHELD] * len(named) + plain


def test_only_awards_that_a_band_can_reach_travel(spark):
    rng, start = random.Random(5), dt.date(1990, 1, 1)
    rows = [dict(award_id=f"a{k:05}", candidate_id=f"RC-a{k:05}", naics="541512", psc="D302", component="m", award_type="BPA CALL", value=float(rng.randint(10**6, 10**7)), pop_start=start, current_end=start + dt.timedelta(700), signed=start + dt.timedelta(rng.randint(0, 3600)), pricing_code="J") for k in range(4000)]
    df = spark.createDataFrame(rows)
    pool = pricing.pool(df)
    assert pricing._needed(pool).count() * 2 < pool.count() == 4000
    some = df.where("award_id < 'a00060'")
    rates = {r.award_id: r.rate for r in df.select("award_id", pricing.run_rate().alias("rate")).collect()}
    got = {}
    for r in pricing.comparables(some, df).select("candidate_id", "comp_id").collect():
        got.setdefault(r.candidate_id, set()).add(r.comp_id)
    for one in rows[:60]:
        mine = rates[one["award_id"]]
        near = [x for x in rows if x is not one and 4 * rates[x["award_id"]] >= mine and rates[x["award_id"]] <= 4 * mine and x["signed"] >= dt.date(1995, 1, 1)]
        assert got[one["candidate_id"]] == {x["award_id"] for x in sorted(near, key=lambda x: (-x["signed"].toordinal(), x["award_id"]))[:40]}
