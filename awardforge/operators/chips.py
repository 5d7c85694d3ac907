"""Reason chips: why a candidate stands where it does, as a ranked array of structs that is never empty.

Each code has cases; the first whose condition holds makes its chip. A chip is observed (a fact of the record), inferred (an
estimate) or missing (nothing to read), and a missing one carries no number. Conditions and evidence are plain SQL for both dialects.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardforge.functions.rules import Dialect, Profile, listed, title_flags

# Codes, ranks, cases and bounds.
MOST = 12
NEAR_DAYS, SOON_DAYS = 182, 365
STRONG_FIT, PARTIAL_FIT = 700, 400
COMPETED = ("A", "D", "F")
EMPTY = "empty_state"
#: Dropped where one of these says that the end date cannot be used.
YIELDS = {"urgency": ("data_gap_end_date", "data_gap_stale")}


class Case(NamedTuple):
    name: str
    kind: str
    when: str
    evidence: str


def _text(x: str) -> str:
    return f"CAST({x} AS VARCHAR(40))"


def cases(d: Dialect, profile: Profile | None = None) -> dict[str, tuple[int, list[Case]]]:
    """``code -> (rank, cases)``; the four codes of a profile only with one."""
    flag = title_flags(d)
    said = lambda x: f"coalesce(trim({x}), '')"
    none = "'not reported'"
    out = {
        "data_gap_title": (0, [Case("data_gap_title", "observed", flag["garbled_title"], "'the title of the record cannot be used'")]),
        "data_gap_end_date": (1, [Case("data_gap_end_date", "observed", flag["missing_end_date"], "'the record gives no end'")]),
        "data_gap_stale": (2, [Case("data_gap_stale", "observed", f"status = 'expired_stale' OR {flag['stale_expiration']}", "'ended more than 90 days ago'")]),
        "incumbent_lock": (10, [Case("incumbent_lock", "observed", f"offers = 1 AND upper({said('extent_code')}) IN ({listed(COMPETED)})", f"'one offer under competition code ' || upper({said('extent_code')})")]),
        "displacement": (12, [
            Case("displacement_missing", "missing", "displacement_basis = 'insufficient'", none),
            Case("displacement_signals", "inferred", "displacement_basis = 'observed' AND displacement_count >= 1", f"{_text('displacement_count')} || ' of ' || {_text('displacement_read')} || ': ' || displacement_signals"),
        ]),
        "set_aside": (15, [
            Case("set_aside_missing", "missing", f"{said('set_aside_code')} = ''", none),
            Case("set_aside_none", "observed", f"upper({said('set_aside_code')}) = 'NONE'", "'coded NONE'"),
            Case("set_aside_restricted", "observed", "true", f"'code ' || {said('set_aside_code')}"),
        ]),
        "urgency": (20, [
            Case("urgency_missing", "missing", "days_left IS NULL", none),
            Case("urgency_near", "observed", f"days_left BETWEEN 0 AND {NEAR_DAYS}", f"'ends ' || {_text('expiry')} || ', days ' || {_text('days_left')}"),
            Case("urgency_soon", "observed", f"days_left BETWEEN {NEAR_DAYS + 1} AND {SOON_DAYS}", f"'ends ' || {_text('expiry')} || ', days ' || {_text('days_left')}"),
        ]),
        "expired_grace": (22, [Case("expired_grace", "observed", "status = 'expired_grace'", f"'ended ' || coalesce({_text('expiry')}, 'recently')")]),
        "recompete": (60, [
            Case("recompete_low", "inferred", "confidence = 'Low'", "'confidence Low'"),
            Case("recompete_conf", "inferred", "confidence IN ('High', 'Medium')", "'confidence ' || confidence"),
            Case("recompete_missing", "missing", "true", none),
        ]),
        "ptw": (70, [
            Case("ptw_available", "observed", "range_basis = 'comparables'", f"{_text('n_comparables')} || ' comparables, ' || strength"),
            Case("ptw_missing", "missing", "true", none),
        ]),
        "idv_task_order": (75, [Case("idv_task_order", "observed", f"{said('parent_idv')} <> ''", f"'under ' || {said('parent_idv')}")]),
        "data_quality": (80, [Case("data_quality_issue", "observed", f"{said('notes')} <> ''", "notes")]),
        "data_gap_code_prefix": (85, [Case("data_gap_code_prefix", "observed", flag["code_prefix"], "'the title had a code before it'")]),
        "data_gap_short_title": (86, [Case("data_gap_short_title", "observed", flag["short_title"], "'the title is very short'")]),
    }
    if profile is None:
        return out
    fit = f"{_text('capability')} || ' of 1000'"
    money = _text("CAST(value AS DECIMAL(18,2))")
    p = profile
    out["capability"] = (40, [
        Case("capability_missing", "missing", "false" if p.naics or p.psc or p.capabilities else "true", none),
        Case("capability_strong", "inferred", f"capability >= {STRONG_FIT}", fit),
        Case("capability_partial", "inferred", f"capability >= {PARTIAL_FIT}", fit),
    ])
    out["value"] = (45, [
        Case("value_missing", "missing", "false" if p.ceiling else "true", none),
        Case("value_in_range", "inferred", "value_fit = 1000", f"{money} || ' within {p.ceiling}'"),
        Case("value_over", "inferred", "value_fit IN (600, 250)", f"{money} || ' over {p.ceiling}'"),
    ])
    out["agency"] = (50, [
        Case("agency_missing", "missing", "false" if p.components else "true", none),
        Case("agency_pastperf", "observed", "agency_fit = 1000", "component"),
        Case("agency_baseline_blank", "inferred", f"{said('component')} IN ('', 'UNKNOWN')", "'no component'"),
        Case("agency_baseline", "inferred", "true", "'not at ' || component"),
    ])
    out["location"] = (55, [
        Case("location_nationwide", "inferred", str(p.nationwide).lower(), "'serves everywhere'"),
        Case("location_missing", "missing", "false" if p.states else "true", none),
        Case("location_state_missing", "missing", f"{said('state')} = ''", none),
        Case("location_in_area", "observed", "location_fit = 1000", "state"),
        Case("location_out_area", "observed", "true", "state"),
    ])
    return out


def _other(code: str):
    return lambda c: c["code"] != code


def chips(scored: DataFrame, d: Dialect, profile: Profile | None = None, most: int = MOST) -> DataFrame:
    """``scored`` (with range and displacement columns) and ``chips``: ``array<struct<rank, code, name, kind, evidence>>`` in rank order, ``most`` at most, a single empty-state chip where nothing else can be said."""
    made = []
    for code, (rank, options) in cases(d, profile).items():
        chosen = " ".join(f"WHEN coalesce({c.when}, false) THEN named_struct('rank', {rank}, 'code', '{code}', 'name', '{c.name}', 'kind', '{c.kind}', 'evidence', {c.evidence})" for c in options)
        made.append(F.expr(f"CASE {chosen} END"))
    x = scored.withColumn("_all", F.array_sort(F.array_compact(F.array(*made))))
    for code, stronger in YIELDS.items():
        codes = F.transform("_all", lambda c: c["code"])
        gone = F.arrays_overlap(codes, F.array(*map(F.lit, stronger)))
        x = x.withColumn("_all", F.when(gone, F.filter("_all", _other(code))).otherwise(F.col("_all")))
    empty = F.expr(f"array(named_struct('rank', 999, 'code', '{EMPTY}', 'name', '{EMPTY}', 'kind', 'missing', 'evidence', 'not reported'))")
    return x.withColumn("chips", F.when(F.size("_all") == 0, empty).otherwise(F.slice("_all", 1, most))).drop("_all")
