"""DuckDB equivalents: one chain of named subqueries, cut to what a query needs."""

from __future__ import annotations

import re

from awardforge.functions import rules
from awardforge.functions.rules import AS_OF, DUCK, Profile
from awardforge.plans import domain

_TIE = "action_date, l_partkey, l_suppkey, l_extendedprice"
_KEY = "(action_date, mod_no, txn_key)"
_EVENT = "{'action_date': action_date, 'mod_no': mod_no, 'txn_key': txn_key, 'action_type_code': action_type_code, 'obligation': obligation}"
_chosen, _basis = rules.expiry()
_class = ", ".join(f"{v} AS {k}" for k, v in rules.classification(DUCK).items())
_parts = ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in rules.score_parts(DUCK, Profile()).items())
_pace = rules.pace(DUCK)

CHAIN = {
    "txn": domain.TXN,
    "notice": domain.NOTICE,
    "kept": f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY txn_key ORDER BY {_TIE}) AS n FROM txn) WHERE n = 1 AND coalesce(delete_ind, '') <> 'D'",
    "latest": f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY award_key ORDER BY action_date DESC, txn_key DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM txn) WHERE n = 1",
    "digest": f"""SELECT award_key, count(*) AS mod_count, min(action_date) AS first_action, max(action_date) AS last_action,
      min_by(ceiling_total, {_KEY}) FILTER (ceiling_total > 0) AS first_ceiling, max_by(ceiling_total, {_KEY}) FILTER (ceiling_total > 0) AS last_ceiling,
      min_by(txn_key, {_KEY}) FILTER (ceiling_total > 0) AS first_ceiling_key, max_by(txn_key, {_KEY}) FILTER (ceiling_total > 0) AS last_ceiling_key,
      min_by(potential_end, {_KEY}) FILTER (potential_end IS NOT NULL) AS first_planned_end, max_by(current_end, {_KEY}) FILTER (current_end IS NOT NULL) AS end_of_record,
      max(current_end) FILTER (extent_code IN ('B', 'C', 'G')) AS bridge_end,
      max_by({_EVENT}, {_KEY}) FILTER (action_type_code IN ('E', 'F', 'X', 'N')) AS t,
      count(*) FILTER (action_type_code IN ('E', 'F', 'X', 'N')) AS n_terminations, count(*) FILTER (obligation < -10000) AS n_negatives,
      min(action_date) FILTER (obligation < -100000 AND action_type_code <> 'K') AS first_deobligation
      FROM kept GROUP BY award_key""",
    "mods0": """SELECT *, CASE WHEN first_ceiling_key <> last_ceiling_key THEN CAST((CAST(last_ceiling * 100 AS HUGEINT) * 20000 + CAST(first_ceiling * 100 AS HUGEINT)) // (CAST(first_ceiling * 100 AS HUGEINT) * 2) AS BIGINT) END AS ceiling_growth,
      CASE WHEN mod_count >= 2 AND last_action > first_action THEN (mod_count * 7305000 + date_diff('day', first_action, last_action)) // (2 * date_diff('day', first_action, last_action)) END AS velocity FROM digest""",
    "mods": """SELECT award_key, mod_count, t IS NOT NULL AS terminated, t.action_type_code AS termination_code, t.action_date AS termination_date,
      CASE WHEN t IS NULL THEN 'none' WHEN end_of_record <= t.action_date + 31 THEN 'complete_likely' ELSE 'partial_or_unclear' END AS termination_kind,
      CASE WHEN t IS NULL THEN 'none' ELSE 'observed_code' END AS termination_basis, ceiling_growth, coalesce(ceiling_growth > 15000, false) AS ceiling_balloon,
      CASE WHEN ceiling_growth IS NULL THEN 'insufficient' ELSE 'measured' END AS ceiling_basis, velocity,
      CASE WHEN velocity IS NULL THEN 'n/a' WHEN velocity > 100000 THEN 'high' WHEN velocity < 10000 THEN 'low' ELSE 'normal' END AS velocity_band,
      coalesce(first_deobligation < first_planned_end, false) AS has_deobligation, coalesce(bridge_end > first_planned_end + 30, false) AS bridge_flag,
      CASE WHEN first_planned_end IS NULL THEN 'insufficient' ELSE 'observed' END AS bridge_basis,
      CASE WHEN mod_count < 2 THEN 'single_transaction' WHEN first_action IS NULL THEN 'insufficient' ELSE 'measured' END AS mods_basis FROM mods0""",
    "clean0": f"""SELECT award_key AS award_id, piid, parent_idv, award_type, naics, psc, description, state, extent_code, set_aside_code, offers, pricing_code, size_code, uei,
      {rules.normal_name(DUCK, "agency")} AS agency, {rules.normal_name(DUCK, "subagency")} AS component, {rules.normal_name(DUCK, "recipient_name", True)} AS vendor,
      total_obligated AS value, ceiling_total AS base_value, action_date AS signed, pop_start, current_end, potential_end,
      concat_ws('; ', CASE WHEN uei IS NULL THEN 'missing UEI' END, CASE WHEN current_end IS NULL AND potential_end IS NULL THEN 'missing end date' END, CASE WHEN total_obligated IS NULL THEN 'missing amount' END) AS notes FROM latest""",
    "clean": "SELECT *, CASE WHEN notes = '' THEN 0 ELSE len(string_split(notes, '; ')) END AS n_notes FROM clean0",
    "award": f"SELECT *, {_class} FROM clean",
    "cand0": f"""SELECT a.* EXCLUDE (description), description AS title, 'RC-' || award_id AS candidate_id, m.* EXCLUDE (award_key),
      CASE WHEN termination_kind = 'complete_likely' AND termination_date IS NOT NULL THEN termination_date ELSE {_chosen} END AS expiry,
      CASE WHEN termination_kind = 'complete_likely' AND termination_date IS NOT NULL THEN 'terminated' ELSE {_basis} END AS expiry_basis
      FROM award a LEFT JOIN mods m ON a.award_id = m.award_key WHERE cyber_it_flag AND value >= {rules.MIN_AWARD}""",
    "cand1": f"""SELECT * REPLACE (coalesce(terminated, false) AS terminated, coalesce(ceiling_balloon, false) AS ceiling_balloon, coalesce(has_deobligation, false) AS has_deobligation, coalesce(bridge_flag, false) AS bridge_flag,
      coalesce(termination_kind, 'none') AS termination_kind, coalesce(termination_basis, 'none') AS termination_basis, coalesce(bridge_basis, 'insufficient') AS bridge_basis, coalesce(mods_basis, 'insufficient') AS mods_basis,
      coalesce(velocity_band, 'n/a') AS velocity_band, coalesce(ceiling_basis, 'insufficient') AS ceiling_basis), {DUCK.days("expiry", AS_OF)} AS days_left FROM cand0""",
    "cand": f"""SELECT *, {rules.status()} AS status, {rules.bucket()} AS bucket, {rules.phase()} AS phase,
      expiry - CASE WHEN value >= 10000000 THEN 548 ELSE 270 END AS window_start, expiry - CASE WHEN value >= 10000000 THEN 180 ELSE 60 END AS window_end FROM cand1""",
    "score0": f"SELECT *, {_parts} FROM cand",
    "score1": f"SELECT *, CAST({rules.total_score(DUCK)} AS BIGINT) AS score10 FROM score0",
    "scored": f"SELECT *, {rules.tier(DUCK)} AS tier, score10 / 10.0::DOUBLE AS score FROM score1",
    "pace0": f"SELECT *, {_pace['burn']} AS burn FROM scored",
    "pace1": f"SELECT *, {_pace['pace_basis']} AS pace_basis FROM pace0",
    "pace2": f"SELECT *, {_pace['pressure']} AS pressure FROM pace1",
    "paced": f"SELECT *, {_pace['pace_band']} AS pace_band FROM pace2",
    "pool": "SELECT *, substr(trim(psc), 1, 2) AS psc2, coalesce(trim(parent_idv), '') AS parent FROM award WHERE trim(naics) <> '' AND trim(psc) <> '' AND trim(component) <> ''",
    "succ": """SELECT c.*, CASE WHEN coalesce(n, 0) < 3 OR expiry IS NULL THEN 'insufficient_cell'
      WHEN EXISTS (SELECT 1 FROM pool p WHERE p.naics = c.naics AND p.psc2 = substr(trim(c.psc), 1, 2) AND p.component = c.component AND p.signed > c.expiry AND p.award_id <> c.award_id
        AND (coalesce(trim(c.parent_idv), '') = '' OR p.parent <> trim(c.parent_idv))) THEN 'observed' ELSE 'none_visible' END AS successor_basis
      FROM scored c LEFT JOIN (SELECT naics, psc2, component, count(*) AS n FROM pool GROUP BY ALL) k ON k.naics = c.naics AND k.psc2 = substr(trim(c.psc), 1, 2) AND k.component = c.component""",
    "shiftcell": """SELECT uei, naics, count(*) AS n, max_by(code, (signed, award_id)) FILTER (signed IS NOT NULL) AS last_code, max(signed) AS last_date, min(signed) FILTER (code = 'S') AS first_small
      FROM (SELECT *, upper(trim(size_code)) AS code FROM award WHERE uei IS NOT NULL AND upper(trim(size_code)) IN ('S', 'O')) GROUP BY uei, naics""",
    "shift": """SELECT uei, CASE WHEN max(n) >= 3 THEN count(*) FILTER (n >= 3 AND last_code = 'O' AND first_small < last_date) > 0 END AS size_shift,
      min(naics) FILTER (n >= 3 AND last_code = 'O' AND first_small < last_date) AS shift_naics, CASE WHEN max(n) >= 3 THEN 'observed' ELSE 'insufficient' END AS size_basis FROM shiftcell GROUP BY uei""",
    "lane": """SELECT c.candidate_id, status, unnest(['bridge', 'termination', 'deobligation', 'lapsed_no_successor', 'sole_offer', 'size_shift']) AS name, unnest([1, 2, 3, 4, 5, 6]) AS o,
      unnest([CASE WHEN bridge_basis = 'observed' THEN CAST(bridge_flag AS INTEGER) END, CASE WHEN terminated THEN 1 WHEN termination_basis = 'none' THEN 0 END, CAST(has_deobligation AS INTEGER),
        CASE WHEN status = 'active' THEN 0 WHEN successor_basis = 'none_visible' THEN 1 WHEN successor_basis = 'observed' THEN 0 END,
        CASE WHEN offers IN (117, 253) OR offers NOT BETWEEN 1 AND 100 THEN NULL WHEN offers > 1 THEN 0 WHEN offers = 1 AND upper(trim(extent_code)) IN ('A', 'D', 'F') THEN 1 END,
        CAST(size_shift AS INTEGER)]) AS s FROM succ c LEFT JOIN shift USING (uei)""",
    "displaced": """SELECT candidate_id, CASE WHEN r >= 3 THEN k END AS displacement_count, r AS displacement_read, CASE WHEN r >= 3 THEN coalesce(fired, 'none') END AS displacement_signals, coalesce(unread, 'none') AS displacement_unread,
      CASE WHEN r < 3 THEN 'n/a' WHEN k >= 2 THEN 'multiple_signals' WHEN k = 1 THEN 'single_signal' ELSE 'none_observed' END AS displacement_band, CASE WHEN r >= 3 THEN 'observed' ELSE 'insufficient' END AS displacement_basis
      FROM (SELECT candidate_id, count(x) AS r, count(*) FILTER (x = 1) AS k, string_agg(name, '+' ORDER BY o) FILTER (x = 1) AS fired, string_agg(name, '+' ORDER BY o) FILTER (x IS NULL) AS unread
        FROM (SELECT *, CASE WHEN status <> 'expired_stale' THEN s END AS x FROM lane) GROUP BY candidate_id)""",
    "reportable": "SELECT * FROM scored WHERE tier <> 'Data Gap'",
    "market": """SELECT component, sum(net) AS market, count(*) FILTER (uei IS NOT NULL AND net > 0) AS n_firms, coalesce(sum(net) FILTER (uei IS NOT NULL AND net > 0), 0) AS attributed, max(net) FILTER (uei IS NOT NULL AND net > 0) AS top
      FROM (SELECT component, nullif(trim(uei), '') AS uei, sum(coalesce(value, 0)) AS net FROM reportable WHERE trim(component) <> '' GROUP BY ALL) GROUP BY component""",
    "concentrated": """SELECT component, n_firms, CASE WHEN reason = '' THEN CAST((CAST(top * 100 AS HUGEINT) * 20000 + CAST(attributed * 100 AS HUGEINT)) // (CAST(attributed * 100 AS HUGEINT) * 2) AS BIGINT) END AS top_share,
      CASE WHEN reason = '' THEN 'observed' ELSE 'insufficient' END AS concentration_basis, reason
      FROM (SELECT *, CASE WHEN n_firms < 3 THEN 'too few vendors' WHEN market <= 0 THEN 'no positive dollars' WHEN attributed * 100 < market * 85 THEN 'unattributed dollars' ELSE '' END AS reason FROM market)""",
}


def query(select: str) -> str:
    """``select`` behind the subqueries that it reads, directly or through others."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in CHAIN:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                visit(CHAIN[name])

    visit(select)
    return "WITH " + ",\n".join(f"{n} AS ({CHAIN[n]})" for n in CHAIN if n in need) + "\n" + select if need else select
