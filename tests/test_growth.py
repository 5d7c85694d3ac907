"""Plans and steps that keep the growing tables within their limits."""

import datetime as dt
import random

from pyspark.sql import functions as F

from awardforge.operators import history, pricing
from awardforge.plans import domain

SF = "/root/testdata/sf0.001"


def test_transactions_are_dealt_by_award_before_the_digest_and_long_methods_are_cut(spark):
    domain.transactions(spark, SF)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
    rows = spark.createDataFrame([("A1", "t1", "P1", "2000-01-01", "C", 1)], "award_key string, txn_key string, mod_no string, action_date string, action_type_code string, l_partkey long").selectExpr(
        "award_key", "txn_key", "mod_no", "cast(action_date as date) action_date", "action_type_code", "cast(-20000 as decimal(18,2)) obligation", "cast(5 as decimal(18,2)) ceiling_total", "date'2001-01-01' potential_end", "date'2001-01-01' current_end", "'B' extent_code"
    )
    plan = history.digest(rows)._jdf.queryExecution().sparkPlan().toString().splitlines()
    dealt = [k for k, x in enumerate(plan) if "Exchange" in x or "Repartition" in x]
    assert dealt and min(dealt) > max(k for k, x in enumerate(plan) if "Aggregate" in x)
    assert [tuple(r) for r in history.digest(rows).selectExpr("award_key", "mod_count", "size(negatives)", "size(terminations)").collect()] == [("A1", 1, 1, 0)]


def test_stream_folds_with_sparks_own_state_and_a_retention_gives_the_same(spark, tmp_path):
    from awardforge.streaming import digest

    rows = [
        ("A", "t1", "P1", "2000-01-01", "C", None, -20000, 5, "2001-01-01", None, "A"), ("A", "t1", "P1", "2000-01-01", "C", None, -20000, 5, "2001-01-01", None, "A"),
        ("A", "t2", "P2", "2000-02-01", "F", None, 7, 9, None, "2001-03-01", "B"), ("A", "t3", "P3", "2000-03-01", "C", "D", 1, 1, None, None, "A"),
        ("B", "t1", "P1", None, "C", None, None, None, None, None, None), ("C", None, "P1", "2000-01-01", "C", None, 1, None, None, None, None), ("C", "", "P1", "2000-01-01", "C", None, 1, None, None, None, None),
    ]
    money = ("obligation", "ceiling_total")
    frame = spark.sql("select * from values " + ", ".join("(" + ", ".join("null" if x is None else repr(x) for x in r) + ")" for r in rows) + " as t(" + ", ".join(digest.FIELDS) + ")")
    frame = frame.selectExpr(*[f"cast({c} as decimal(18,2)) {c}" if c in money else f"cast({c} as date) {c}" if c in ("action_date", "potential_end", "current_end") else f"cast({c} as string) {c}" for c in digest.FIELDS])
    frame.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    # no Python call an award
    assert "Pandas" not in digest.aggregated(stream)._jdf.queryExecution().analyzed().toString()
    found = []
    for name, retention in (("own", None), ("python", 10**9)):
        digest.stream_digest(spark, f"{tmp_path}/in", frame.schema, f"{tmp_path}/{name}-state", f"{tmp_path}/{name}", files=1, retention_ms=retention)
        x = digest.current(spark, f"{tmp_path}/{name}")
        found.append({r.award_key: r for r in x.select(*sorted(x.columns)).collect()})
    assert found[0] == found[1]
    assert (found[0]["A"].mod_count, found[0]["A"].obligation, found[0]["C"].mod_count, found[0]["B"].obligation) == (2, -19993, 2, 0)
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "false") == "false"


def test_candidates_read_the_awards_of_their_office_and_not_all_of_the_cell(spark, tmp_path, monkeypatch):
    rng, start, n = random.Random(11), dt.date(1995, 1, 1), 2400
    rows = [dict(award_id=f"a{k:05}", candidate_id=f"RC-a{k:05}", naics="541512", psc="D302", component=f"c{k % 40:02}", award_type="BPA CALL", value=float(rng.randint(10**6, 4 * 10**6)), pop_start=start, current_end=start + dt.timedelta(700), signed=start + dt.timedelta(rng.randint(0, 1000)), pricing_code="J") for k in range(n)]
    df = spark.createDataFrame(rows).withColumn("value", F.col("value").cast("decimal(18,2)"))
    choose, seen = pricing._choose, str(tmp_path / "seen")

    def counted(*args):
        chosen = choose(*args)

        def count(a, p):
            with open(seen, "a") as out:
                out.write(f"{len(p)}\n")
            return chosen(a, p)

        return count

    monkeypatch.setattr(pricing, "_choose", counted)
    found = pricing.comparable_sets(df, df, part=100)
    assert {r.rung for r in found.select("rung").collect()} == {"A"} and found.count() == n
    # each of three passes reads the office once or, where its candidates are cut, once a part
    with open(seen) as f:
        assert sum(int(x) for x in f) <= 8 * n
