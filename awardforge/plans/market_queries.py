"""Registered queries: prices, links, trust, snapshots, profiles, checks, sources and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from awardforge.functions import rules
from awardforge.functions.rules import AS_OF
from awardforge.operators import candidates, linking, pricing, trust
from awardforge.plans import domain
from awardforge.plans.award_queries import FIRMS, _standing, awards, cand, held, kept, mods, money, registered, scored, succeeded
from awardforge.plans.oracle import CHAIN
from awardforge.sources import labels, tables
from awardforge.streaming import digest

_D = f"date_diff('day', pop_start, least(coalesce(current_end, {AS_OF}), {AS_OF}))"
_RATE = f"CASE WHEN value > 0 AND {_D} > 0 THEN CAST((CAST(value * 100 AS HUGEINT) * 36525) // (100 * greatest(least({_D}, {pricing.MOST_DAYS}), {pricing.LEAST_DAYS})) AS BIGINT) END"
CHAIN |= {
    "compool": f"""SELECT substr(naics, 1, 4) AS family, substr(psc, 1, 2) AS class, award_id AS comp_id, naics AS comp_naics, component AS comp_component, rate AS comp_rate, coalesce(signed >= {AS_OF} - INTERVAL 60 MONTH, false) AS recent, signed, psc AS comp_psc, value AS comp_value, {pricing.PRICING} AS comp_pricing, coalesce(current_end > {AS_OF}, false) AS comp_running
      FROM (SELECT *, {_RATE} AS rate FROM award WHERE upper(award_type) IN ({rules.listed(pricing.TYPES)})) WHERE rate IS NOT NULL""",
    "compair": f"""SELECT c.candidate_id, p.*, c.rate, CASE WHEN size AND recent AND same AND at_home THEN 1 WHEN size AND recent AND same THEN 2 WHEN size THEN 3 ELSE 4 END AS own
      FROM (SELECT candidate_id, award_id, naics, component, substr(naics, 1, 4) AS family, substr(psc, 1, 2) AS class, {_RATE} AS rate FROM cand) c
      JOIN (SELECT * FROM compool) p ON p.family = c.family AND p.class = c.class AND p.comp_id <> c.award_id,
      LATERAL (SELECT p.comp_naics = c.naics AS same, p.comp_component = c.component AS at_home, c.rate IS NULL OR (p.comp_rate * 4 >= c.rate AND p.comp_rate <= 4 * c.rate) AS size) x""",
    "comprung": "SELECT candidate_id, CASE WHEN count(*) FILTER (own = 1) >= 5 THEN 1 WHEN count(*) FILTER (own <= 2) >= 5 THEN 2 WHEN count(*) FILTER (own <= 3) >= 5 THEN 3 WHEN count(*) >= 5 THEN 4 END AS rung FROM compair GROUP BY candidate_id",
    "comps": "SELECT * FROM (SELECT p.*, r.rung, row_number() OVER (PARTITION BY candidate_id ORDER BY own, signed DESC NULLS LAST, comp_id) AS place FROM compair p JOIN comprung r USING (candidate_id) WHERE own <= rung) WHERE place <= 40",
    "btrate": f"SELECT * FROM (SELECT award_id, naics, substr(psc, 1, 2) AS class, component, signed, current_end, {_RATE} AS rate FROM award WHERE signed IS NOT NULL) WHERE rate IS NOT NULL",
    "btpair": f"""SELECT x.award_id, x.naics, x.class, x.current_end, x.rate, arg_min(y.award_id, (y.signed, y.award_id)) AS next_id, arg_min(y.rate, (y.signed, y.award_id)) AS next_rate
      FROM btrate x JOIN btrate y ON y.naics = x.naics AND y.class = x.class AND y.component = x.component AND y.signed > x.current_end AND y.award_id <> x.award_id WHERE x.current_end < {AS_OF} GROUP BY ALL""",
    "nid": "SELECT *, upper(regexp_replace(coalesce(solicitation_number, ''), '[^A-Za-z0-9]', '', 'g')) AS id FROM notice",
    "cid": "SELECT DISTINCT candidate_id, id FROM (SELECT candidate_id, unnest([upper(regexp_replace(coalesce(piid, ''), '[^A-Za-z0-9]', '', 'g')), upper(regexp_replace(coalesce(parent_idv, ''), '[^A-Za-z0-9]', '', 'g'))]) AS id FROM cand) WHERE id <> ''",
    "idpair": """SELECT c.candidate_id, n.notice_id, n.notice_type, n.posted_date, CASE WHEN posted_date < pop_start THEN 'origin'
        WHEN posted_date IS NOT NULL AND coalesce(expiry, current_end) IS NOT NULL AND NOT coalesce(posted_date BETWEEN expiry - INTERVAL 24 MONTH AND expiry + INTERVAL 12 MONTH, false)
          AND NOT coalesce(posted_date BETWEEN current_end - INTERVAL 24 MONTH AND current_end + INTERVAL 12 MONTH, false) THEN 'recency' END AS gate,
        100 + CASE WHEN c.naics = n.naics THEN 15 ELSE 0 END + CASE WHEN c.agency = n.agency THEN 10 ELSE 0 END + CASE WHEN upper(c.state) = upper(n.state) THEN 8 ELSE 0 END AS rank
      FROM cand c JOIN cid USING (candidate_id) JOIN nid n ON n.id = cid.id""",
    "idlink": """SELECT c.candidate_id, b.notice_id, b.notice_type, CASE WHEN b.notice_id IS NULL THEN 'No Match' ELSE 'High' END AS link_confidence,
      CASE WHEN b.notice_id IS NOT NULL THEN 'linked' WHEN g.recency THEN 'outside both windows' WHEN g.origin THEN 'posted before the award began' ELSE 'no establishing match' END AS link_reason
      FROM cand c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY rank DESC, notice_id) AS place FROM idpair WHERE gate IS NULL) WHERE place = 1) b USING (candidate_id)
      LEFT JOIN (SELECT candidate_id, bool_or(gate = 'recency') AS recency, bool_or(gate = 'origin') AS origin FROM idpair GROUP BY 1) g USING (candidate_id)""",
}


_PRICED = ["award_id", "award_type", "piid", "naics", "psc", "component", "value", "pop_start", "current_end", "potential_end", "signed", "pricing_code", "offers", "extent_code", "cyber_it_flag"]


def priced(s, d):
    """Candidates and awards with what pricing reads of them, from one table that is written once. Modifications move a candidate's expiry only, which pricing does not read."""
    a = _staged(s, "priced", awards(s, d).select(*_PRICED))
    return candidates.build(a), a


@registered("g2_comparables", "SELECT candidate_id, chr(CAST(64 + rung AS INTEGER)) AS rung, count(*) AS n, CAST(sum(comp_rate) AS BIGINT) AS sum_rate FROM comps GROUP BY candidate_id, rung")
def g2(s, d):
    total = F.aggregate("comps", F.lit(0).cast("long"), lambda a, x: a + x["comp_rate"])
    return pricing.comparable_sets(*priced(s, d)).select("candidate_id", "rung", F.size("comps").cast("long").alias("n"), total.alias("sum_rate"))


@registered("g3_run_rate", f"SELECT award_id, {_RATE} AS rate FROM award")
def g3(s, d):
    return awards(s, d).select("award_id", pricing.run_rate().alias("rate"))


_PLACES = ", ".join(f"({n}, {k})" for n, k in pricing.median_places().items())
_LEVEL = "CASE WHEN rung = 4 THEN 'Weak' " + " ".join(
    f"WHEN n >= {n} AND (ci_high - ci_low) / median <= {width}::DOUBLE AND n_running / n <= {running}::DOUBLE THEN " + ("CASE WHEN contains(families, ',') THEN 'Moderate' ELSE 'Strong' END" if name == "Strong" else f"'{name}'") for name, (n, width, running) in pricing.STRENGTH.items()
) + " ELSE 'Weak' END"


def _ranged(comps: str, factor: float = 1.0) -> str:
    """SQL: the range of each candidate over a select of comparables; under five there is none."""
    return f"""SELECT *, {_LEVEL} AS strength FROM (
      SELECT candidate_id, rung, n, n_running, families, low * {factor}::DOUBLE AS low, median * {factor}::DOUBLE AS median, high * {factor}::DOUBLE AS high, ws[k] * {factor}::DOUBLE AS ci_low, ws[n + 1 - k] * {factor}::DOUBLE AS ci_high FROM (
        SELECT candidate_id, any_value(rung) AS rung, count(*) AS n, count(*) FILTER (comp_running) AS n_running, coalesce(string_agg(DISTINCT comp_pricing, ',' ORDER BY comp_pricing), '') AS families,
          quantile_cont(w, 0.25) AS low, quantile_cont(w, 0.5) AS median, quantile_cont(w, 0.75) AS high, list_sort(list(w)) AS ws
        FROM (SELECT *, least(greatest(CAST(comp_rate AS DOUBLE), lo), hi) AS w FROM ({comps}) x
          JOIN (SELECT candidate_id, quantile_cont(CAST(comp_rate AS DOUBLE), 0.05) AS lo, quantile_cont(CAST(comp_rate AS DOUBLE), 0.95) AS hi FROM ({comps}) GROUP BY 1) USING (candidate_id)) GROUP BY candidate_id)
      JOIN (VALUES {_PLACES}) p(n, k) USING (n))"""


CHAIN["ranged"] = _ranged("SELECT * FROM comps")


@registered(
    "g4_price_range",
    f"""SELECT candidate_id, chr(CAST(64 + rung AS INTEGER)) AS rung, coalesce(n, 0) AS n_comparables, round(low, 0) AS low, round(median, 0) AS median, round(high, 0) AS high, coalesce(strength, 'Insufficient') AS strength,
      (n_running * 2000 + n) // (2 * n) AS running_permille, CASE WHEN families = '' THEN 'unknown' ELSE families END AS pricing_mix, CASE WHEN n IS NULL THEN 'insufficient' ELSE 'comparables' END AS range_basis, candidate_rate,
      CAST(round((candidate_rate - median) / median * 1000, 0) AS BIGINT) AS divergence, CASE WHEN candidate_rate IS NOT NULL THEN candidate_rate < low OR candidate_rate > high END AS outside, not_competed
    FROM (SELECT candidate_id, {_RATE} AS candidate_rate, coalesce(upper(trim(extent_code)) IN ({rules.listed(pricing.NOT_COMPETED)}), false) AS not_competed FROM cand) c LEFT JOIN ranged USING (candidate_id)""",
)
def g4(s, d):
    c, a = priced(s, d)
    x = pricing.ranges(c, pricing.comparable_sets(c, a))
    return x.select("candidate_id", "rung", "n_comparables", *[F.round(v, 0).alias(v) for v in ("low", "median", "high")], "strength", "running_permille", "pricing_mix", "range_basis", "candidate_rate", "divergence", "outside", "not_competed")


@registered("g4_median_interval", "SELECT candidate_id, round(ci_low, 0) AS ci_low, round(ci_high, 0) AS ci_high FROM ranged")
def g4b(s, d):
    c, a = priced(s, d)
    x = pricing.ranges(c, pricing.comparable_sets(c, a)).where("range_basis = 'comparables'")
    return x.select("candidate_id", F.round("ci_low", 0).alias("ci_low"), F.round("ci_high", 0).alias("ci_high"))


@registered(
    "g5_comparables_table",
    f"""SELECT candidate_id, comp_id, chr(CAST(64 + own AS INTEGER)) AS own_rung, comp_rate, comp_psc, CAST(comp_value AS DOUBLE) AS comp_value, comp_running, a.* EXCLUDE (award_id), 'obligated_run_rate' AS value_basis FROM comps
    JOIN (SELECT award_id, piid AS comp_piid, component AS comp_component, naics AS comp_naics, offers AS comp_offers, pricing_code AS comp_pricing_code, pop_start AS comp_start, current_end AS comp_end, signed AS comp_signed,
      greatest(least({_D}, {pricing.MOST_DAYS}), {pricing.LEAST_DAYS}) AS comp_days FROM award) a ON a.award_id = comp_id""".replace("SELECT candidate_id, comp_id, chr(CAST(64 + own AS INTEGER)) AS own_rung, comp_rate, comp_psc", "SELECT c.candidate_id, c.comp_id, chr(CAST(64 + own AS INTEGER)) AS own_rung, c.comp_rate, c.comp_psc").replace("FROM comps\n", "FROM (SELECT candidate_id, comp_id, own, comp_rate, comp_psc, comp_value, comp_running FROM comps) c\n"),
)
def g5(s, d):
    return money(pricing.audit(*priced(s, d)).withColumn("comp_days", F.col("comp_days").cast("long")))


@registered(
    "i4_range_by_psc",
    "SELECT comp_psc, count(*) AS n, CAST(min(comp_value) AS DOUBLE) AS least, quantile_cont(CAST(comp_value AS DOUBLE), 0.5) AS median, CAST(max(comp_value) AS DOUBLE) AS most FROM comps WHERE comp_value > 0 GROUP BY comp_psc HAVING count(*) >= 8",
)
def i4(s, d):
    pricing.listed(pricing.comparable_sets(*priced(s, d), ["comp_id", "comp_psc", "comp_value"])).createOrReplaceTempView("comparables")
    return s.sql("SELECT comp_psc, count(*) AS n, CAST(min(comp_value) AS DOUBLE) AS least, percentile(CAST(comp_value AS DOUBLE), 0.5) AS median, CAST(max(comp_value) AS DOUBLE) AS most FROM comparables WHERE comp_value > 0 GROUP BY comp_psc HAVING count(*) >= 8")


@registered(
    "g7_backtest",
    """SELECT p.award_id, count(*) AS n_comparables, p.next_rate BETWEEN quantile_cont(CAST(z.rate AS DOUBLE), 0.25) AND quantile_cont(CAST(z.rate AS DOUBLE), 0.75) AS contained
    FROM btpair p JOIN btrate z ON z.naics = p.naics AND z.class = p.class AND z.award_id <> p.award_id AND z.award_id <> p.next_id AND z.signed <= p.current_end AND z.rate * 4 >= p.rate AND z.rate <= 4 * p.rate
    GROUP BY p.award_id, p.next_rate HAVING count(*) >= 5""",
)
def g7(s, d):
    return pricing.backtest(awards(s, d))


@registered(
    "g7_coverage",
    """SELECT n_pairs, n_contained, CASE WHEN n_pairs > 0 THEN (n_contained * 2000 + n_pairs) // (2 * n_pairs) END AS coverage_permille, CASE WHEN n_pairs > 0 THEN 'measured' ELSE 'no pairs' END AS basis FROM (SELECT count(*) AS n_pairs, count(*) FILTER (contained) AS n_contained FROM (
    SELECT p.next_rate BETWEEN quantile_cont(CAST(z.rate AS DOUBLE), 0.25) AND quantile_cont(CAST(z.rate AS DOUBLE), 0.75) AS contained
    FROM btpair p JOIN btrate z ON z.naics = p.naics AND z.class = p.class AND z.award_id <> p.award_id AND z.award_id <> p.next_id AND z.signed <= p.current_end AND z.rate * 4 >= p.rate AND z.rate <= 4 * p.rate
    GROUP BY p.award_id, p.next_rate HAVING count(*) >= 5))""",
)
def g7b(s, d):
    return pricing.coverage(g7(s, d))


def _staged(s, tag: str, df):
    return tables.written(df, tag)


_LINKABLE = ["candidate_id", "piid", "parent_idv", "title", "naics", "agency", "state", "pop_start", "expiry", "current_end"]


@registered("g1_id_links", "SELECT * FROM idlink")
def g1(s, d, c=None):
    """``c``: candidates that are written already."""
    c = linkable(s, d) if c is None else c
    return linking.links(c.select(*_LINKABLE), domain.notices(s, d), by_title=False)


def linkable(s, d, *also):
    """Candidates with what linking reads of them, and the columns ``also``, written once."""
    return _staged(s, "linkable", (scored if "tier" in also else cand)(s, d).select(*_LINKABLE, *also))


@registered("g1_title_links")
def g1b(s, d):
    """Candidates are read many times on this path, so what linking needs of them is written once."""
    return linking.links(linkable(s, d), domain.notices(s, d))


@registered("b13_notice_lens", "SELECT notice_id, notice_type FROM notice WHERE lower(notice_type) LIKE '%sources sought%' OR lower(notice_type) LIKE '%request for information%' OR regexp_matches(lower(notice_type), '\\brfi\\b')")
def b13(s, d):
    t = F.lower("notice_type")
    return domain.notices(s, d).where(t.contains("sources sought") | t.contains("request for information") | t.rlike(r"\brfi\b")).select("notice_id", "notice_type")


_LIVE = f"SELECT candidate_id, arg_min(n.notice_id, (response_deadline, n.notice_id)) AS notice_id, arg_min(set_aside_code, (response_deadline, n.notice_id)) AS notice_code, min(response_deadline) AS deadline FROM idlink JOIN (SELECT notice_id, set_aside_code, response_deadline FROM notice) n USING (notice_id) WHERE response_deadline >= {AS_OF} AND trim(set_aside_code) <> '' GROUP BY candidate_id"


@registered("f9_live_notice", _LIVE)
def f9(s, d, c=None):
    n = domain.notices(s, d).select("notice_id", "set_aside_code", "response_deadline").where(f"response_deadline >= {AS_OF} and trim(set_aside_code) <> ''")
    first = F.struct("response_deadline", "notice_id")
    x = g1(s, d, c).join(n, "notice_id").where("link_confidence = 'High'")
    return x.groupBy("candidate_id").agg(F.min_by("notice_id", first).alias("notice_id"), F.min_by("set_aside_code", first).alias("notice_code"), F.min("response_deadline").alias("deadline"))


#: Firms as in f7, and one whose certificates are not on file.
UNKNOWN_FIRM = "delta"


def _live_standing() -> str:
    at = f"SELECT candidate_id, notice_code AS set_aside_code FROM ({_LIVE})"
    return " UNION ALL ".join(f"SELECT '{f}' AS firm, candidate_id, set_aside_code AS notice_code, {rules.eligibility(c, e)} AS notice_eligible FROM ({at})" for f, (c, e) in FIRMS.items())


_LANE = f"""SELECT *, CASE WHEN nc <> '' OR code NOT IN ('', 'NONE') THEN CASE WHEN nc <> '' THEN notice_eligible ELSE eligible END ELSE true END AS checked FROM (
  SELECT s.firm, s.candidate_id, eligible, notice_eligible, CASE WHEN upper(trim(coalesce(notice_code, ''))) = 'NONE' THEN '' ELSE upper(trim(coalesce(notice_code, ''))) END AS nc, upper(trim(coalesce(set_aside_code, ''))) AS code
  FROM ({_standing()} UNION ALL SELECT '{UNKNOWN_FIRM}', candidate_id, set_aside_code, NULL FROM cand) s LEFT JOIN ({_live_standing()}) l ON l.firm = s.firm AND l.candidate_id = s.candidate_id
  ) x""".replace(f"LEFT JOIN ({_live_standing()})", f"LEFT JOIN ({_live_standing()} UNION ALL SELECT '{UNKNOWN_FIRM}', candidate_id, notice_code, NULL FROM ({_LIVE}))")


@registered(
    "f8_prime_path",
    f"""SELECT firm, candidate_id, CASE WHEN checked IS NULL THEN 'unknown' WHEN nc <> '' THEN CASE WHEN checked THEN 'clear' ELSE 'gate' END WHEN code = '' THEN 'unknown' WHEN code = 'NONE' OR checked THEN 'clear' ELSE 'warn' END AS lane,
    CASE WHEN checked IS NULL THEN 'no_profile' WHEN nc <> '' THEN 'notice_confirmed' WHEN code = '' THEN 'not_reported' ELSE 'historical_fpds' END AS lane_basis, CASE WHEN nc <> '' THEN nc ELSE code END AS source_code,
    NOT coalesce(checked, true) AS teaming FROM ({_LANE})""",
)
def f8(s, d):
    """The expiring contract's code, and that of the nearest live notice where there is one; the firm without certificates is checked against nothing."""
    from awardforge.operators import signals

    c = linkable(s, d, "set_aside_code")
    live = f9(s, d, c)
    unknown = lambda df, code: df.select(F.lit(UNKNOWN_FIRM).alias("firm"), "candidate_id", code, F.lit(None).cast("boolean").alias("eligible"))
    standing = signals.eligible(c, FIRMS).unionByName(unknown(c, "set_aside_code"))
    on_notice = live.select("candidate_id", F.col("notice_code").alias("set_aside_code"))
    there = signals.eligible(on_notice, FIRMS).unionByName(unknown(on_notice, "set_aside_code"))
    return signals.prime_path(standing, there.withColumnsRenamed({"set_aside_code": "notice_code", "eligible": "notice_eligible"}))


@registered("f8_lane_counts", f"SELECT firm, lane, count(*) AS n FROM (SELECT firm, CASE WHEN checked IS NULL THEN 'unknown' WHEN nc <> '' THEN CASE WHEN checked THEN 'clear' ELSE 'gate' END WHEN code = '' THEN 'unknown' WHEN code = 'NONE' OR checked THEN 'clear' ELSE 'warn' END AS lane FROM ({_LANE})) GROUP BY ALL")
def f8b(s, d):
    return f8(s, d).groupBy("firm", "lane").agg(F.count(F.lit(1)).alias("n"))


@registered(
    "f10_response_clock",
    f"SELECT candidate_id, coalesce(min(response_deadline) FILTER (response_deadline >= {AS_OF}), max(response_deadline)) AS clock FROM idlink JOIN (SELECT notice_id, response_deadline FROM notice) USING (notice_id) GROUP BY candidate_id",
)
def f10(s, d):
    x = g1(s, d).join(domain.notices(s, d).select("notice_id", "response_deadline"), "notice_id")
    return x.groupBy("candidate_id").agg(F.coalesce(F.min(F.expr(f"case when response_deadline >= {AS_OF} then response_deadline end")), F.max("response_deadline")).alias("clock"))


_LABEL = "CASE CAST(substr(notice_id, 2) AS BIGINT) % 5 WHEN 0 THEN 'incorrect' WHEN 1 THEN 'unsure' ELSE 'correct' END"
_W = "(k / n + 1.9208 / n {0} 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)"


@registered(
    "j2_link_precision",
    f"""SELECT link_confidence, CAST(n AS BIGINT) AS n, unsure, CASE WHEN n < 30 THEN 'below_floor' WHEN kinds = 1 THEN 'bulk_fill' ELSE 'measured' END AS gate_state, round(CASE WHEN n >= 30 AND kinds > 1 THEN k / n END, 9) AS "precision",
    round(CASE WHEN n >= 30 AND kinds > 1 THEN {_W.format("-")} END, 9) AS ci_low, round(CASE WHEN n >= 30 AND kinds > 1 THEN {_W.format("+")} END, 9) AS ci_high FROM (
    SELECT link_confidence, CAST(count(*) FILTER (label = 'correct') AS DOUBLE) AS k, CAST(count(*) FILTER (label <> 'unsure') AS DOUBLE) AS n, count(*) FILTER (label = 'unsure') AS unsure, count(DISTINCT label) AS kinds
    FROM (SELECT *, {_LABEL} AS label FROM idlink WHERE notice_id IS NOT NULL) GROUP BY 1)""",
)
def j2(s, d, h=None):
    labels = g1(s, d, None if h is None else cand(s, d, h)).where("notice_id is not null").withColumn("label", F.expr(_LABEL))
    x = trust.link_precision(labels)
    return x.select("link_confidence", "n", "unsure", "gate_state", *[F.round(c, 9).alias(c) for c in ("precision", "ci_low", "ci_high")])


_BASES = {"successor_basis": "insufficient_cell", "bridge_basis": "insufficient", "mods_basis": "single_transaction", "ceiling_basis": "insufficient"}


@registered("j4_abstention", " UNION ALL ".join(f"SELECT '{b}' AS metric, count(*) AS n, count(*) FILTER ({b} = '{r}') AS refused, (count(*) FILTER ({b} = '{r}') * 2000 + count(*)) // (2 * count(*)) AS refused_permille FROM succ" for b, r in _BASES.items()))
def j4(s, d, h=None):
    return trust.abstention(succeeded(s, d, h), _BASES)


@registered(
    "j7_naive_against_scored",
    """SELECT 50 AS n_naive, 50 AS n_scored, (SELECT count(*) FROM (SELECT candidate_id FROM nv INTERSECT SELECT candidate_id FROM sv)) AS n_both, (SELECT count(*) FROM nv JOIN scored USING (candidate_id) WHERE tier = 'Data Gap') AS naive_quarantined""".replace("FROM nv ", "FROM (SELECT candidate_id FROM scored WHERE days_left >= 0 ORDER BY value DESC, candidate_id LIMIT 50) nv ").replace("FROM sv", "FROM (SELECT candidate_id FROM scored WHERE days_left >= 0 AND tier <> 'Data Gap' ORDER BY score10 DESC, candidate_id LIMIT 50) sv"),
)
def j7(s, d):
    return trust.naive_against_scored(_staged(s, "book", scored(s, d).select("candidate_id", "value", "days_left", "tier", "score10")))


def snapshots(s, d, days: tuple[str, ...], h=None):
    """The pipeline as it ran on each day: awards and their histories are built once, only what depends on the day is repeated."""
    when = F.explode(F.array(*[F.lit(x).cast("date") for x in days])).alias("snapshot_date")
    dated = cand(s, d, h).select("*", when)
    return candidates.scored(candidates.runway(dated, "snapshot_date"))


_DAYS = ("1999-07-01", "1999-10-01", "2000-01-01")


def _on(day: str) -> str:
    """The scored select as of another day."""
    chain = {k: CHAIN[k].replace(AS_OF, f"DATE '{day}'") for k in ("cand1", "cand", "score0", "score1", "scored")}
    out = "SELECT * FROM cand0"
    for k, source in (("cand1", "cand0"), ("cand", "cand1"), ("score0", "cand"), ("score1", "score0"), ("scored", "score1")):
        out = f"SELECT * FROM ({chain[k].replace(f'FROM {source}', f'FROM ({out}) {source}')})" if source != "cand0" else f"SELECT * FROM ({chain[k]})"
    return out


@registered(
    "j6_rank_stability",
    f"""SELECT a.snapshot_date, count(*) AS n_shared, count(*) FILTER (a.place <= 50 AND b.place <= 50) AS top_overlap, count(*) FILTER (a.tier <> b.tier) AS n_moved FROM ranked a JOIN ranked b ON a.candidate_id = b.candidate_id AND a.k = b.k + 1 GROUP BY 1""".replace(
        "FROM ranked a", "FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY score10 DESC, candidate_id) AS place FROM snaps) a"
    ).replace("JOIN ranked b", "JOIN (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY score10 DESC, candidate_id) AS place FROM snaps) b").replace(
        "FROM snaps", "FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, DATE '{x}' AS snapshot_date, candidate_id, tier, score10 FROM ({_on(x)})" for k, x in enumerate(_DAYS)) + ")"
    ),
)
def j6(s, d):
    return trust.rank_stability(_staged(s, "snapshots", _snapshots(s, d)))


def _snapshots(s, d, h=None):
    return snapshots(s, d, _DAYS, h).select("snapshot_date", "candidate_id", "tier", "score10", "days_left")


@registered(
    "j5_lead_time",
    "SELECT candidate_id, first_seen, posted, CAST(date_diff('day', first_seen, posted) AS BIGINT) AS lead_days FROM (SELECT candidate_id, DATE '1999-07-01' AS first_seen, min(posted_date) AS posted FROM idlink JOIN (SELECT notice_id, posted_date FROM notice) USING (notice_id) WHERE link_confidence IN ('High', 'Medium') AND posted_date IS NOT NULL GROUP BY candidate_id)",
)
def j5(s, d):
    h = held(s, d)
    return trust.lead_time(_snapshots(s, d, h), g1(s, d, cand(s, d, h)), domain.notices(s, d)).withColumn("lead_days", F.col("lead_days").cast("long"))


_CELLS = """SELECT candidate_id, score10, CASE WHEN value >= 10000000 THEN '>=$10M' WHEN value >= 1000000 THEN '$1M-$10M' ELSE '<$1M' END AS band, CASE WHEN component IN (SELECT component FROM (SELECT component, count(*) AS n FROM scored GROUP BY 1 ORDER BY n DESC, component LIMIT 5)) THEN component ELSE 'OTHER' END AS office,
  CASE WHEN trim(coalesce(parent_idv, '')) = '' THEN 'standalone' ELSE 'vehicle' END AS kind FROM scored"""
_SIZE = 200


@registered(
    "j9_label_sample",
    f"""SELECT candidate_id, band, office, kind, CASE WHEN d AND t THEN 'both' WHEN t THEN 'top50' ELSE 'stratified' END AS sample_set FROM (
      SELECT *, row_number() OVER (PARTITION BY band, office, kind ORDER BY md5('7:' || candidate_id), candidate_id) <= 1 + base + CASE WHEN turn <= {_SIZE} - cells - handed THEN 1 ELSE 0 END AS d, row_number() OVER (ORDER BY score10 DESC, candidate_id) <= 50 AS t
      FROM ({_CELLS}) JOIN (SELECT *, sum(base) OVER () AS handed, row_number() OVER (ORDER BY over_ DESC, band, office, kind) AS turn FROM (
        SELECT band, office, kind, cells, ((n - 1) * ({_SIZE} - cells)) // (total - cells) AS base, ((n - 1) * ({_SIZE} - cells)) % (total - cells) AS over_ FROM (SELECT band, office, kind, count(*) AS n, count(*) OVER () AS cells, sum(count(*)) OVER () AS total FROM ({_CELLS}) GROUP BY 1, 2, 3))) USING (band, office, kind)) WHERE d OR t""",
)
def j9(s, d):
    return trust.label_sample(_staged(s, "book", scored(s, d).select("candidate_id", "component", "score10", "value", "parent_idv")), _SIZE)


#: An outcome sheet made from candidates, with faults in it: award numbers decide which.
_N = "CAST(substr(candidate_id, 13) AS BIGINT)"
_SHEET = {
    "case_id": f"CASE WHEN {_N} % 997 = 5 THEN '' WHEN {_N} % 991 = 7 THEN 'O-again' ELSE 'O-' || candidate_id END",
    "sample_set": f"CASE WHEN {_N} % 53 = 1 THEN 'other' WHEN {_N} % 2 = 0 THEN 'stratified' ELSE 'top50' END",
    "sampled_snapshot_date": "'2000-01-01'",
    "potential_end_date": f"CASE WHEN {_N} % 71 = 2 THEN 'soon' ELSE CAST(expiry AS VARCHAR(10)) END",
    "outcome_label": f"CASE {_N} % 5 WHEN 0 THEN 'undeterminable' WHEN 1 THEN 'ended' WHEN 2 THEN '' ELSE 'recompete_unchanged' END",
    "undeterminable_reason": f"CASE WHEN {_N} % 5 = 0 AND {_N} % 3 > 0 THEN 'no_notice_found' WHEN {_N} % 101 = 1 THEN 'insufficient_history' END",
    "label_confidence": f"CASE {_N} % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN ' low ' END",
    "notice_anchored": f"CASE WHEN {_N} % 12 = 4 THEN 'N' ELSE 'Y' END",
    "unmask_performed": f"CASE WHEN {_N} % 7 = 0 THEN 'Y' WHEN {_N} % 7 = 1 THEN 'N' END",
    "unmask_date": f"CASE WHEN {_N} % 7 = 0 AND {_N} % 5 > 0 THEN '1999-12-31' WHEN {_N} % 301 = 3 THEN '1999-12-30' END",
    "incumbent_retained_observed": f"CASE WHEN {_N} % 7 = 0 THEN 'yes' END",
    "label_changed_after_unmask": f"CASE WHEN {_N} % 11 = 0 THEN 'Y' END",
    "labeler_notes": f"CASE WHEN {_N} % 22 = 0 THEN 'seen twice' END",
}
_SAID = ", ".join(f"trim(coalesce({v}, '')) AS {k}" for k, v in _SHEET.items())
_RULE_ROWS = [("case_id blank", "case_id = ''")]
_RULE_ROWS += [(f"{c} not in its list", f"{c} <> '' AND {c} NOT IN ({rules.listed(v)})") for c, v in labels.LISTS["outcome"].items()]
_RULE_ROWS += [(f"{c} is no date", f"{c} <> '' AND TRY_CAST({c} AS DATE) IS NULL") for c in ("sampled_snapshot_date", "potential_end_date", "unmask_date")]
_RULE_ROWS += list(labels.ACROSS.items())


@registered(
    "a10_label_contract",
    f"""SELECT rule, count(*) AS n, arg_min(case_id, ("row", case_id)) AS first_case FROM (
      {" UNION ALL ".join(f"SELECT '{rule}' AS rule, n AS row, case_id FROM sheet WHERE {broken}" for rule, broken in _RULE_ROWS)}
      UNION ALL SELECT 'case_id repeated', min(n), case_id FROM sheet WHERE case_id <> '' GROUP BY case_id HAVING count(*) > 1) GROUP BY rule""".replace("FROM sheet", f"FROM (SELECT {_N} AS n, {_SAID} FROM cand) sheet"),
)
def a10(s, d):
    """An outcome sheet with faults of every kind: each broken rule, how often, and the first case by row."""
    sheet = cand(s, d).select(F.expr(_N).alias("row"), *[F.expr(_SHEET.get(c, "cast(null as string)")).alias(c) for c in labels.OUTCOME_COLUMNS])
    return labels.summary(labels.violations(sheet, "outcome"))


_OLD, _NEW = "1999-10-01", "2000-01-01"
_LINKED = "SELECT DISTINCT candidate_id, notice_id FROM cid JOIN nid USING (id) WHERE posted_date <= DATE '{0}'"
_DIFF = f"""SELECT 'New candidate' AS rule, candidate_id, tier AS detail FROM ({_on(_NEW)}) WHERE signed > DATE '{_OLD}' AND signed <= DATE '{_NEW}'
  UNION ALL SELECT 'Tier change', a.candidate_id, b.tier || ' > ' || a.tier FROM ({_on(_NEW)}) a JOIN ({_on(_OLD)}) b ON a.candidate_id = b.candidate_id AND a.tier <> b.tier WHERE a.signed <= DATE '{_OLD}'
  UNION ALL SELECT 'New notice link', candidate_id, notice_id FROM ({_LINKED.format(_NEW)} EXCEPT {_LINKED.format(_OLD)})"""


@registered("k2_snapshot_diff", _DIFF)
def k2(s, d):
    """Two snapshots of what was known on each day: awards signed and notices posted by then."""
    c = _staged(s, "known", snapshots(s, d, (_OLD, _NEW)).select("snapshot_date", "candidate_id", "tier", "signed", "piid", "parent_idv"))
    both = c.where("signed <= snapshot_date").select("snapshot_date", "candidate_id", "tier")
    known = linking.id_links(c.where(F.col("snapshot_date") == F.lit(_NEW).cast("date")), domain.notices(s, d)).join(domain.notices(s, d).select("notice_id", "posted_date"), "notice_id")
    known = _staged(s, "links", known.select("candidate_id", "notice_id", "posted_date"))
    at = lambda df, c, day: df.where(F.col(c) == F.lit(day).cast("date")) if c == "snapshot_date" else df.where(F.col(c) <= F.lit(day).cast("date"))
    return trust.diff(at(both, "snapshot_date", _OLD), at(both, "snapshot_date", _NEW), at(known, "posted_date", _OLD), at(known, "posted_date", _NEW))


@registered("k3_alert_counts", f"SELECT mode, rule, count(*) AS n FROM ({_DIFF}) JOIN (SELECT unnest(['all', 'action_needed', 'new_only']) AS mode) ON mode = 'all' OR (mode = 'action_needed' AND rule <> 'New candidate') OR (mode = 'new_only' AND rule = 'New candidate') GROUP BY ALL")
def k3(s, d):
    return trust.alerts(k2(s, d)).groupBy("mode", "rule").agg(F.count(F.lit(1)).alias("n"))


_TOP = "(SELECT uei, string_agg({0}, ',' ORDER BY place) AS top_{0} FROM (SELECT uei, {0}, row_number() OVER (PARTITION BY uei ORDER BY count(*) DESC, sum(value) DESC, {0}) AS place FROM award WHERE uei IS NOT NULL AND {0} IS NOT NULL GROUP BY uei, {0}) WHERE place <= 3 GROUP BY uei)"


@registered(
    "l1_firm_profiles",
    "SELECT uei, n_awards, round(p90, 0) AS p90, top_naics, top_psc, top_component FROM (SELECT uei, count(*) AS n_awards, quantile_cont(CAST(value AS DOUBLE), 0.9) FILTER (value > 0) AS p90 FROM award WHERE uei IS NOT NULL GROUP BY uei) " + " ".join(f"LEFT JOIN {_TOP.format(c)} USING (uei)" for c in ("naics", "psc", "component")),
)
def l1(s, d):
    return trust.profiles(awards(s, d)).withColumn("p90", F.round("p90", 0))


_RULES = {
    "unique_id_has_award": "candidate_id = 'RC-' || award_id",
    "value_at_least": f"value >= {rules.MIN_AWARD}",
    "expiry_has_basis": "(expiry IS NULL) = (expiry_basis = 'unknown')",
    "quarantine_is_gap": "(status <> 'expired_stale') OR tier = 'Data Gap'",
    "velocity_has_band": "(velocity IS NULL) = (velocity_band = 'n/a')",
    "growth_has_basis": "(ceiling_growth IS NULL) = (ceiling_basis = 'insufficient')",
    "complete_is_ended": "termination_kind <> 'complete_likely' OR expiry_basis = 'terminated'",
    "score_in_range": "score10 BETWEEN 0 AND 1000",
    "bucket_matches_days": "(bucket = 'Expired - verify') = coalesce(days_left < 0, true)",
}


@registered("m1_invariants", " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (NOT coalesce({c}, false)) = 0 AS ok, count(*) FILTER (NOT coalesce({c}, false)) AS failing FROM scored" for n, c in _RULES.items()))
def m1(s, d):
    return trust.checks(scored(s, d), _RULES)


@registered("b6_scrubbed_documents")
def b6(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", tables.scrub(F.col("text")).alias("text")).where("text like '%REDACTED]%'").select("doc_id", F.length("text").alias("n_chars"))


@registered("b14_search", "SELECT candidate_id FROM scored WHERE contains(lower(title), 'cyber') OR contains(lower(vendor), 'cyber') OR contains(lower(component), 'cyber')")
def b14(s, d):
    hit = None
    for c in ("title", "vendor", "component"):
        one = F.lower(c).contains("cyber")
        hit = one if hit is None else hit | one
    return scored(s, d).where(hit).select("candidate_id")


@registered("b15_facets", "SELECT candidate_id, CAST(value AS DOUBLE) AS value FROM scored WHERE component IN ('NATION_1', 'NATION_2') AND tier IN ('Tier 2: Capture Research', 'Tier 3: Monitor') AND value BETWEEN 1000000 AND 5000000")
def b15(s, d):
    x = scored(s, d).where(F.col("component").isin("NATION_1", "NATION_2") & F.col("tier").isin("Tier 2: Capture Research", "Tier 3: Monitor") & F.col("value").between(1_000_000, 5_000_000))
    return money(x.select("candidate_id", "value"))


@registered("a1_transaction_scan", f"SELECT naics, count(*) AS n, CAST(sum(obligation) AS DOUBLE) AS obligation FROM txn WHERE naics IN ({rules.listed(rules.NAICS_SCOPE)}) GROUP BY naics")
def a1(s, d):
    """Transactions written as bulk CSV and scanned back."""
    t = domain.transactions(s, d)
    columns = {"txn_key": 0, "award_key": 1, "piid": 2, "mod_no": 3, "action_date": 4, "action_type_code": 5, "delete_ind": 6, "obligation": 7, "potential_end": 8, "recipient_name": 9, "uei": 10, "naics": 11, "psc": 12, "description": 13}
    path = _shared(s, "csv")
    t.select(*[F.col(c).cast("string").alias(tables.TRANSACTION_COLUMNS[k]) for c, k in columns.items()]).write.option("header", True).option("escape", '"').csv(path)
    return money(tables.scan_transactions(s, path).groupBy("naics").agg(F.count(F.lit(1)).alias("n"), F.sum("obligation").alias("obligation")))


_shared = tables.scratch


@registered("a6_snapshot_archive", f"SELECT snapshot_date, count(*) AS n FROM (SELECT DATE '1999-10-01' AS snapshot_date FROM scored UNION ALL SELECT {AS_OF} FROM scored) GROUP BY 1")
def a6(s, d):
    """Two dates archived, the second one twice: each date holds one clean copy."""
    path = _shared(s, "snapshots")
    both = _staged(s, "dated", snapshots(s, d, ("1999-10-01", "2000-01-01")).select("snapshot_date", "candidate_id", "tier", "score10"))
    for day in ("1999-10-01", "2000-01-01", "2000-01-01"):
        tables.archive(both.where(F.col("snapshot_date") == F.lit(day).cast("date")).drop("snapshot_date"), path, day)
    return s.read.parquet(path).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"))


@registered("a6_manifest")
def a6b(s, d):
    return tables.manifest({"awards": awards(s, d), "candidates": cand(s, d)})


@registered("a12_fact_claims")
def a12(s, d):
    return tables.fact_claims(scored(s, d))


@registered(
    "c11_streamed_digest",
    "SELECT award_key, mod_count, first_action, last_action, CAST(first_ceiling AS DOUBLE) AS first_ceiling, CAST(last_ceiling AS DOUBLE) AS last_ceiling, first_ceiling_key, last_ceiling_key, first_planned_end, end_of_record, bridge_end, n_terminations, t.txn_key AS termination_key, n_negatives, CAST(o AS DOUBLE) AS obligation "
    "FROM digest JOIN (SELECT award_key, sum(obligation) AS o FROM kept GROUP BY award_key) USING (award_key)",
)
def c11(s, d):
    """All transactions as a stream of files, some delivered twice and late, retracted rows among them."""
    base = _shared(s, "stream")
    t = kept(s, d).select(*digest.FIELDS)
    # a retracted row beside every fifth one, made on the way so that transactions are read once
    gone = F.explode(F.expr("case when pmod(xxhash64(txn_key), 5) = 0 then array(false, true) else array(false) end")).alias("gone")
    marked = {"delete_ind": F.when(F.col("gone"), "D").otherwise(F.col("delete_ind")), "txn_key": F.when(F.col("gone"), F.concat("txn_key", F.lit("_R"))).otherwise(F.col("txn_key"))}
    t = t.select("*", gone).withColumns(marked).drop("gone")
    t.repartition(6, "txn_key").write.parquet(f"{base}/in")
    s.read.parquet(f"{base}/in").where("pmod(xxhash64(txn_key), 3) = 0").repartition(2).write.mode("append").parquet(f"{base}/in")
    digest.stream_digest(s, f"{base}/in", t.schema, f"{base}/state", f"{base}/out")
    x = digest.current(s, f"{base}/out")
    last = F.try_element_at("terminations", F.lit(-1))["txn_key"].alias("termination_key")
    return money(x.select("award_key", "mod_count", "first_action", "last_action", "first_ceiling", "last_ceiling", "first_ceiling_key", "last_ceiling_key", "first_planned_end", "end_of_record", "bridge_end", F.size("terminations").cast("long").alias("n_terminations"), last, F.size("negatives").cast("long").alias("n_negatives"), "obligation"))
