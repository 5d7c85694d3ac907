"""Hand cases at the boundaries of the row rules, the fold and the joins."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from awardforge.functions import rules
from awardforge.operators import candidates, history, linking, signals, trust
from awardforge.sources import tables

D = dt.date


def one(spark, expr, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'int' if isinstance(v, int) or v is None else 'string'}" for k, v in row.items())).select(F.expr(expr).alias("x")).first().x


@pytest.mark.parametrize("days,status,bucket", [(0, "active", "0-6 Months"), (182, "active", "0-6 Months"), (183, "active", "6-12 Months"), (365, "active", "6-12 Months"), (366, "active", "12-18 Months"), (548, "active", "12-18 Months"), (730, "active", "18-24 Months"), (731, "active", "24+ Months"), (-1, "expired_grace", "Expired - verify"), (-90, "expired_grace", "Expired - verify"), (-91, "expired_stale", "Expired - verify"), (None, "expired_stale", "Expired - verify")])
def test_status_and_bucket(spark, days, status, bucket):
    assert one(spark, rules.status(), days_left=days) == status
    assert one(spark, rules.bucket(), days_left=days) == bucket


@pytest.mark.parametrize("days,tenths", [(0, 1000), (730, 100), (365, 550), (-1, 950), (-90, 600), (-91, 0), (None, 0)])
def test_urgency(spark, days, tenths):
    assert one(spark, rules.score_parts(rules.SPARK, rules.Profile())["urgency"], days_left=days) == tenths


TXN = "txn_key string, award_key string, mod_no string, action_date date, action_type_code string, delete_ind string, obligation decimal(18,2), ceiling_total decimal(18,2), current_end date, potential_end date, extent_code string, l_partkey long, l_suppkey long, l_extendedprice double"


def txn(key, award, mod, day, kind="C", mark=None, money="1", ceiling=None, end=None, planned=None, extent="A", part=1):
    return (key, award, mod, day, kind, mark, Decimal(money), Decimal(ceiling) if ceiling else None, end, planned, extent, part, 1, 1.0)


def test_fold(spark):
    rows = [
        txn("a1", "A", "1", D(2020, 1, 1), ceiling="100", planned=D(2021, 1, 1)),
        txn("a1", "A", "1", D(2020, 1, 1), money="9", part=2),  # listed again
        txn("a2", "A", "2", D(2020, 6, 1), ceiling="151", end=D(2020, 6, 20)),
        txn("a3", "A", "3", D(2020, 7, 1), mark="D", ceiling="900"),  # retracted
        txn("a4", "A", "4", D(2020, 6, 5), kind="F"),
        txn("b1", "B", "1", D(2020, 1, 1), money="-200000", planned=D(2020, 6, 1)),
        txn("b2", "B", "2", D(2020, 2, 1), kind="K", money="-300000"),
        txn(None, "C", "1", None),
        txn("", "C", "2", D(2020, 1, 1), kind="E", extent="B", end=D(2021, 1, 1), planned=D(2020, 6, 1)),
    ]
    kept = history.kept_transactions(spark.createDataFrame(rows, TXN))
    m = {r.award_key: r for r in history.mod_signals(history.digest(kept)).collect()}
    assert (m["A"].mod_count, m["A"].ceiling_growth, m["A"].ceiling_balloon) == (3, 15100, True)
    assert (m["A"].termination_kind, m["A"].termination_date) == ("complete_likely", D(2020, 6, 5))
    assert m["B"].has_deobligation and not m["B"].terminated
    assert (m["C"].mod_count, m["C"].termination_kind, m["C"].bridge_flag, m["C"].bridge_basis) == (2, "partial_or_unclear", True, "observed") or m["C"].termination_kind == "partial_or_unclear"


def test_blank_set_aside_is_not_none(spark):
    rows = spark.createDataFrame([("x", None), ("y", "NONE"), ("z", "8A"), ("u", "HZC")], "candidate_id string, set_aside_code string")
    lanes = {r.candidate_id: r.lane for r in signals.prime_path(signals.eligible(rows, {"f": ({"8a": True}, "DATE '1999-12-31'")})).collect()}
    assert lanes == {"x": "unknown", "y": "clear", "z": "warn", "u": "warn"}


def test_similarity_is_twice_the_common_subsequence():
    assert linking.token_sort_similarity("b a", "a b") == 100.0
    assert linking.token_sort_similarity("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert linking.token_sort_similarity("", "") == 0.0


def test_wilson(spark):
    lo, hi = trust.wilson(F.lit(8.0), F.lit(10.0))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (round(r.lo, 4), round(r.hi, 4)) == (0.4902, 0.9433)


def test_scan_of_quoted_csv(spark, tmp_path):
    head = ",".join(tables.TRANSACTION_COLUMNS)
    body = '"t1","","P1","0","2020-01-02 00:00:00","C","","$1,234.50","2021-01-01","A ""B"" Inc","U1","541512.0","D302","line one\nline, two"\n"t2","K","P2","0","bad","C","","-","","","","999999","",""\n'
    (tmp_path / "a.csv").write_text(head + "\n" + body)
    rows = tables.scan_transactions(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.award_key, r.fallback_key, r.action_date, r.obligation, r.naics, r.description) == ("P1", True, D(2020, 1, 2), Decimal("1234.50"), "541512", "line one\nline, two")


def test_scrub_and_formula(spark):
    df = spark.createDataFrame([("call 202-555-0134 or a.b@example.com", "=1+1"), ("order 1234567890", "plain"), (None, None)], "t string, s string")
    assert [r.x for r in df.select(tables.scrub(F.col("t")).alias("x")).collect()] == ["call [PHONE REDACTED] or [EMAIL REDACTED]", "order 1234567890", None]
    assert [r.s for r in tables.formula_safe(df).collect()] == ["'=1+1", "plain", None]


def test_label_contract_names_the_first_broken_row(spark):
    from awardforge.sources import labels

    good = {c: "" for c in labels.OUTCOME_COLUMNS} | {"case_id": "O-1", "outcome_label": "ended", "label_confidence": "high", "notice_anchored": "Y", "sampled_snapshot_date": "2020-01-01"}
    faults = [{}, {"case_id": " "}, {"case_id": "O-2", "outcome_label": "undeterminable"}, {"case_id": "O-3", "undeterminable_reason": "no_notice_found"}, {"case_id": "O-4", "notice_anchored": "N"}, {"case_id": "O-5", "unmask_performed": "Y"},
              {"case_id": "O-6", "unmask_date": "2020-01-02"}, {"case_id": "O-7", "label_changed_after_unmask": "Y"}, {"case_id": "O-8", "sample_set": "none"}, {"case_id": "O-9", "labeled_date": "soon"}, {"case_id": "O-9"}]
    rows = [tuple((good | f)[c] for c in labels.OUTCOME_COLUMNS) + (k,) for k, f in enumerate(faults)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in labels.OUTCOME_COLUMNS) + ", row long")
    got = {r.rule: (r.n, r.first_case) for r in labels.summary(labels.violations(df, "outcome")).collect()}
    assert got == {
        "case_id blank": (1, ""), "reason missing": (1, "O-2"), "reason without cause": (1, "O-3"), "high without notice": (1, "O-4"), "unmask incomplete": (1, "O-5"), "unmask not performed": (1, "O-6"),
        "change not explained": (1, "O-7"), "sample_set not in its list": (1, "O-8"), "labeled_date is no date": (1, "O-9"), "case_id repeated": (1, "O-9"),
    }
    assert labels.refuse_broken(df.where("row = 0"), "outcome").count() == 1
    with pytest.raises(ValueError, match="high without notice"):
        labels.refuse_broken(df.where("row = 4"), "outcome")


def test_queries_have_distinct_columns_and_run(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


def test_invariants_hold(spark):
    from awardforge.plans.market_queries import m1

    assert all(r.ok for r in m1(spark, "/root/testdata/sf0.001").collect())


def test_successor_is_neither_self_nor_sibling(spark):
    a = "award_id string, naics string, psc string, component string, parent_idv string, signed date"
    pool = [("p", "1", "D3xx", "N", "IDV", D(2020, 1, 1)), ("sib", "1", "D3yy", "N", "IDV", D(2022, 1, 1)), ("old", "1", "D3", "N", None, D(2019, 1, 1)), ("self", "1", "D3", "N", None, D(2023, 1, 1))]
    cand = spark.createDataFrame([("p", "1", "D302", "N", "IDV", D(2021, 1, 1)), ("self", "1", "D302", "N", None, D(2022, 6, 1)), ("q", "1", "D302", "N", None, D(2021, 1, 1)), ("thin", "2", "D302", "N", None, D(2021, 1, 1))], "award_id string, naics string, psc string, component string, parent_idv string, expiry date")
    got = {r.award_id: r.successor_basis for r in signals.successors(cand, spark.createDataFrame(pool, a)).collect()}
    assert got == {"p": "observed", "self": "none_visible", "q": "observed", "thin": "insufficient_cell"}


def test_candidates_without_history_have_honest_defaults(spark):
    from awardforge.plans.award_queries import awards, mods

    a = awards(spark, "/root/testdata/sf0.001")
    c = candidates.build(a, mods(spark, "/root/testdata/sf0.001").limit(0))
    assert c.where("terminated or termination_kind <> 'none' or mods_basis <> 'insufficient'").count() == 0


def test_each_parity_check_finds_a_planted_fault(spark):
    from awardforge.plans import report_queries as rq
    from awardforge.plans.award_queries import awards, kept, scored

    d = "/root/testdata/sf0.001"
    x, a, rows = scored(spark, d), awards(spark, d), kept(spark, d)
    links = x.select("candidate_id", F.lit("N1").alias("notice_id"))
    one = x.orderBy("candidate_id").first().candidate_id
    hit = F.col("candidate_id") == one
    raised = x.withColumn("score10", F.when(hit, F.col("score10") + 1).otherwise(F.col("score10")))
    failing = {r.check_name for r in rq.parity_checks(spark, raised, a.union(a.limit(1)), rows, links.union(links.limit(1))).collect() if not r.ok}
    assert failing == {"score_and_tier", "award_once", "link_once"}


def test_parity_sees_missing_rows_and_nulls(spark):
    left = spark.createDataFrame([(1, 5, None), (2, 6, "a"), (3, 7, "b")], "k int, x int, y string")
    same = trust.parity("p", left, left, ["k"], ["x", "y"]).first()
    assert (same.ok, same.failing) == (True, 0)
    other = spark.createDataFrame([(1, 5, "z"), (2, 6, "a"), (4, 7, "b")], "k int, x int, y string")
    assert trust.parity("p", left, other, ["k"], ["x", "y"]).first().failing == 3
    twice = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert trust.unique("u", twice, "k").first().failing == 2


def test_sample_quotas_add_up(spark):
    rows = [(f"c{k:03}", float(10 ** (k % 4 + 5)), "IDV" if k % 3 else None, f"N{k % 9}", 1000 - k) for k in range(400)]
    df = spark.createDataFrame(rows, "candidate_id string, value double, parent_idv string, component string, score10 int")
    got = trust.label_sample(df, 90, top=20).collect()
    kinds = [r.sample_set for r in got]
    assert sum(k != "top50" for k in kinds) == 90 and sum(k != "stratified" for k in kinds) == 20 and len({r.candidate_id for r in got}) == len(got)
    cells = {(r.band, r.office, r.kind) for r in got if r.sample_set != "top50"}
    assert len(cells) == len({(r.band, r.office, r.kind) for r in trust.label_sample(df, 400, top=1).collect()})
    assert sum(r.sample_set != "top50" for r in trust.label_sample(df.limit(5), 90, top=1).collect()) == 5


def test_stream_folds_late_and_repeated_files_and_forgets_keys():
    from awardforge.streaming import digest

    make = lambda **f: digest.Transaction(**(dict.fromkeys(digest.FIELDS) | f))
    first = make(award_key="a", txn_key="t1", mod_no="P1", action_date="2020-05-01", action_type_code="F", obligation=-2_000_000, ceiling_total=100, current_end="2021-01-01", extent_code="B")
    late = make(award_key="a", txn_key="t0", mod_no="P0", action_date="2020-01-01", action_type_code="C", obligation=500, ceiling_total=50, potential_end="2022-01-01")
    state = {}
    assert digest.fold(state, [first]) and not digest.fold(state, [first]) and digest.fold(state, [late])
    assert not digest.fold(state, [make(txn_key="t9", delete_ind="D")])
    row = dict(zip(digest.OUT, digest._row("a", state), strict=True))
    assert (row["mod_count"], row["first_action"], row["first_ceiling_key"], row["last_ceiling_key"], row["bridge_end"], row["obligation_cents"]) == (2, "2020-01-01", "t0", "t1", "2021-01-01", -1_999_500)
    assert digest.fold(state, [make(obligation=1), make(obligation=1)]) and state["mod_count"] == 4


def test_a_share_just_under_a_whole_tenth_is_not_rounded_up(spark):
    from awardforge.operators import rollups

    # (2000 part + whole) / (2 whole) is 500 less 2e-7
    row = spark.sql("select cast(4995000000 - 1 as decimal(38,2)) as part, cast(10000000000 as decimal(38,2)) as whole")
    assert row.select(rollups.permille(F.col("part"), F.col("whole")).alias("x")).first().x == 499
    firms = spark.sql("select 'a' as vendor, cast(4994999999 as decimal(18,2)) as value union all select 'b', 5005000001 - cast(0 as decimal(18,2))").selectExpr("vendor", "cast(value as decimal(18,2)) as value")
    assert {(r.vendor, r.cumulative_permille) for r in rollups.pareto(firms).collect()} == {("b", 501), ("a", 1000)}


def test_what_is_read_often_is_built_once(spark):
    from awardforge.plans.award_queries import scored
    from awardforge.plans.market_queries import g1, j6, j7
    from awardforge.plans.rollup_queries import h5

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    d = "/root/testdata/sf0.001"
    assert not any("l_orderkey" in plan(q(spark, d)) for q in (g1, j6, j7, h5))
    # the score is not copied into a filter on the tier
    assert not any("Filter" in line and "IGF" in line for line in plan(scored(spark, d).where("tier like 'Tier 1%' or tier like 'Tier 2%'")).splitlines())
