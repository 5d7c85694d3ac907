"""Registered queries from transactions to signals, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardforge.functions import rules
from awardforge.functions.rules import DUCK, SPARK, Profile
from awardforge.operators import candidates, history, signals
from awardforge.plans import domain
from awardforge.plans.oracle import query
from awardforge.sources import tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def registered(name: str, select: str | None = None):
    def put(f):
        QUERIES[name] = f
        if select:
            ORACLE[name] = query(select)
        return f

    return put


def kept(s: SparkSession, d: str) -> DataFrame:
    return history.kept_transactions(domain.transactions(s, d))


def awards(s: SparkSession, d: str) -> DataFrame:
    return award_rows(histories(s, d))


def mods(s: SparkSession, d: str) -> DataFrame:
    return history.mod_signals(history.digest(kept(s, d)))


def histories(s: SparkSession, d: str, events: bool = False) -> DataFrame:
    """Awards with their signals. A query that reads awards or candidates several times writes them once (:func:`held`) and passes them on as ``h``."""
    return history.histories(domain.histories(s, d), events)


def held(s: SparkSession, d: str, events: bool = False) -> DataFrame:
    return tables.written(histories(s, d, events), "histories")


def award_rows(h: DataFrame) -> DataFrame:
    return h.drop("mods", "terminations", "negatives")


def cand(s: SparkSession, d: str, h: DataFrame | None = None) -> DataFrame:
    return candidates.build((histories(s, d) if h is None else h).drop("terminations", "negatives"))


def scored(s: SparkSession, d: str, h: DataFrame | None = None) -> DataFrame:
    return candidates.scored(cand(s, d, h))


def reportable(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).where("tier <> 'Data Gap'")


def money(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for output only."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


_NAMES = ["agency", "component", "vendor"]


@registered("b3_normal_names", "SELECT award_id, agency, component, vendor, notes FROM clean")
def b3(s, d):
    return history.clean_awards(history.latest_records(domain.transactions(s, d))).select("award_id", *_NAMES, "notes")


@registered("b12_classification", f"SELECT award_id, signals, confidence, cyber_it_flag, {', '.join(rules.TOPICS)} FROM award")
def b12(s, d):
    return awards(s, d).select("award_id", "signals", "confidence", "cyber_it_flag", *rules.TOPICS)


@registered("c1_latest_record", "SELECT award_key, txn_key, mod_no, action_date, CAST(ceiling_total AS DOUBLE) AS ceiling_total, description FROM latest")
def c1(s, d):
    return money(history.latest_records(domain.transactions(s, d)).select("award_key", "txn_key", "mod_no", "action_date", "ceiling_total", "description"))


@registered("c2_kept_transactions", "SELECT txn_key, award_key, action_date, CAST(obligation AS DOUBLE) AS obligation FROM kept")
def c2(s, d):
    return money(kept(s, d).select("txn_key", "award_key", "action_date", "obligation"))


@registered(
    "c3_award_digest",
    "SELECT award_key, mod_count, first_action, last_action, CAST(first_ceiling AS DOUBLE) AS first_ceiling, CAST(last_ceiling AS DOUBLE) AS last_ceiling, first_planned_end, end_of_record, bridge_end, n_terminations, n_negatives FROM digest",
)
def c3(s, d):
    x = history.digest(kept(s, d)).withColumns({"n_terminations": F.size("terminations").cast("long"), "n_negatives": F.size("negatives").cast("long")})
    return money(x.drop("terminations", "negatives", "first_ceiling_key", "last_ceiling_key"))


@registered("c4_mod_signals", "SELECT * FROM mods")
def c4(s, d):
    return mods(s, d)


@registered("c10_evidence_rows", """SELECT award_key, CAST(count(*) AS BIGINT) AS n_events, CAST(sum(obligation) AS DOUBLE) AS obligation, min(action_date) AS first_date FROM
    (SELECT DISTINCT award_key, mod_no, action_date, action_type_code, obligation FROM kept WHERE action_type_code IN ('E', 'F', 'X', 'N') OR obligation < -10000) GROUP BY award_key""")
def c10(s, d):
    rows = history.evidence_rows(history.digest(kept(s, d)))
    return rows.groupBy("award_key").agg(F.count("transaction_id").alias("n_events"), F.sum("obligation").cast("double").alias("obligation"), F.min("action_date").alias("first_date"))


_expiry = ["current", "earliest", "potential"]


@registered("d1_expiry_policies", "SELECT award_id, " + ", ".join(f"{e} AS {p}_expiry, {b} AS {p}_basis" for p in _expiry for e, b in [rules.expiry(p)]) + " FROM clean")
def d1(s, d):
    c = history.clean_awards(history.latest_records(domain.transactions(s, d)))
    return c.select("award_id", *[F.expr(x).alias(f"{p}_{n}") for p in _expiry for x, n in zip(rules.expiry(p), ("expiry", "basis"), strict=True)])


@registered("d3_candidates", "SELECT candidate_id, expiry, expiry_basis, CAST(days_left AS BIGINT) AS days_left, bucket, phase, status, window_start, window_end, terminated, termination_kind, mods_basis, CAST(value AS DOUBLE) AS value FROM cand")
def d3(s, d):
    return money(cand(s, d).select("candidate_id", "expiry", "expiry_basis", F.col("days_left").cast("long").alias("days_left"), "bucket", "phase", "status", "window_start", "window_end", "terminated", "termination_kind", "mods_basis", "value"))


@registered("d7_runway_on_another_day", "SELECT status, bucket, phase, count(*) AS n FROM (SELECT *, " + ", ".join(f"{r('dl')} AS {n}" for n, r in (("status", rules.status), ("bucket", rules.bucket), ("phase", rules.phase))) + " FROM (SELECT candidate_id, date_diff('day', DATE '1999-06-30', expiry) AS dl FROM cand)) GROUP BY ALL")
def d7(s, d):
    return candidates.runway(cand(s, d), "DATE '1999-06-30'").groupBy("status", "bucket", "phase").agg(F.count(F.lit(1)).alias("n"))


@registered("d8_default_view", "SELECT candidate_id, tier, score FROM scored WHERE days_left >= 0 AND confidence IN ('Medium', 'High') AND tier <> 'Data Gap'")
def d8(s, d):
    return candidates.default_view(scored(s, d)).select("candidate_id", "tier", "score")


@registered("d8_quarantine", f"SELECT candidate_id, {', '.join(f'{x} AS {n}' for n, x in rules.title_flags(DUCK).items())} FROM cand WHERE {rules.quarantined(DUCK)}")
def d8q(s, d):
    return cand(s, d).where(rules.quarantined(SPARK)).select("candidate_id", *[F.expr(x).alias(n) for n, x in rules.title_flags(SPARK).items()])


@registered("e6_scores", f"SELECT candidate_id, {', '.join(rules.WEIGHTS)}, score10, tier, score FROM scored")
def e6(s, d):
    return scored(s, d).select("candidate_id", *rules.WEIGHTS, "score10", "tier", "score")


PROFILES = [Profile(), Profile("large", naics=("541611", "236220"), psc=("R425",), capabilities=("analytics",), ceiling=500_000_000, nationwide=True), Profile("new", naics=(), psc=(), capabilities=("rmf",), ceiling=None, states=())]


def _other(p: Profile) -> str:
    safe = Profile(p.name, p.naics or ("-",), p.psc or ("-",), p.capabilities, p.ceiling, p.components, p.states or ("-",), p.nationwide)
    parts = ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in rules.score_parts(DUCK, safe).items())
    return f"SELECT '{p.name}' AS profile, {rules.tier(DUCK)} AS tier, score10 FROM (SELECT *, CAST({rules.total_score(DUCK)} AS BIGINT) AS score10 FROM (SELECT *, {parts} FROM cand))"


@registered("e7_rescored_tiers", "SELECT profile, tier, count(*) AS n, CAST(sum(score10) AS BIGINT) AS score10 FROM (" + " UNION ALL ".join(_other(p) for p in PROFILES) + ") GROUP BY ALL")
def e7(s, d):
    safe = [Profile(p.name, p.naics or ("-",), p.psc or ("-",), p.capabilities, p.ceiling, p.components, p.states or ("-",), p.nationwide) for p in PROFILES]
    return candidates.rescored(cand(s, d), safe).groupBy("profile", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("score10").alias("score10"))


@registered("e8_score_breakdown", " UNION ALL ".join(f"SELECT candidate_id, '{c}' AS component, CAST({w} AS BIGINT) AS weight_pct, {c} AS raw10, {w} * {c} AS weighted1000 FROM scored" for c, w in rules.WEIGHTS.items()))
def e8(s, d):
    return candidates.breakdown(scored(s, d))


@registered("f1_pace", "SELECT candidate_id, burn, pace_basis, pressure, pace_band FROM paced")
def f1(s, d):
    return signals.pace(scored(s, d)).select("candidate_id", "burn", "pace_basis", "pressure", "pace_band")


def succeeded(s, d, h=None):
    h = held(s, d) if h is None else h
    return signals.successors(scored(s, d, h), award_rows(h))


@registered("f2_successor", "SELECT candidate_id, successor_basis, CASE WHEN successor_basis <> 'insufficient_cell' THEN successor_basis = 'observed' END AS successor_visible FROM succ")
def f2(s, d):
    return succeeded(s, d).select("candidate_id", "successor_basis", "successor_visible")


@registered("d9_bridge_watch", "SELECT candidate_id FROM succ WHERE status = 'expired_grace' AND successor_basis = 'none_visible'")
def d9(s, d):
    return succeeded(s, d).where("status = 'expired_grace' and successor_basis = 'none_visible'").select("candidate_id")


@registered("f3_displacement", "SELECT * FROM displaced")
def f3(s, d):
    h = held(s, d)
    x = signals.displacement(succeeded(s, d, h), signals.size_shift(award_rows(h)))
    return x.select("candidate_id", "displacement_count", "displacement_read", "displacement_signals", "displacement_unread", "displacement_band", "displacement_basis")


@registered("f5_size_shift", "SELECT * FROM shift")
def f5(s, d):
    return signals.size_shift(awards(s, d))


@registered("f6_concentration", "SELECT * FROM concentrated")
def f6(s, d):
    return signals.concentration(reportable(s, d))


FIRMS = {"alpha": ({"8a": True, "small": True, "hubzone": True}, "DATE '1999-12-31'"), "beta": ({"edwosb": True, "sdvosb": True}, None), "gamma": ({}, None)}


def _standing() -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS firm, candidate_id, set_aside_code, {rules.eligibility(c, e)} AS eligible FROM cand" for f, (c, e) in FIRMS.items())


@registered("f7_eligibility", f"SELECT firm, set_aside_code, eligible, count(*) AS n FROM ({_standing()}) GROUP BY ALL")
def f7(s, d):
    return signals.eligible(cand(s, d), FIRMS).groupBy("firm", "set_aside_code", "eligible").agg(F.count(F.lit(1)).alias("n"))


