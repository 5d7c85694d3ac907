"""Registered rollups, dimensions and the analyst SQL pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from awardforge.functions import rules
from awardforge.functions.rules import AS_OF
from awardforge.operators import rollups
from awardforge.plans.award_queries import awards, cand, money, registered, scored
from awardforge.plans.market_queries import _staged

_IN = "CASE WHEN days_left BETWEEN 0 AND {} THEN value END"
_PERMILLE = "CASE WHEN {1} > 0 THEN CAST((CAST(({0}) * 100 AS HUGEINT) * 2000 + CAST(({1}) * 100 AS HUGEINT)) // (CAST(({1}) * 100 AS HUGEINT) * 2) AS BIGINT) END"
_p = _PERMILLE.format


@registered(
    "h1_incumbents",
    f"""SELECT vendor, uei, n_candidates, CAST(total AS DOUBLE) AS total, CAST(value_6m AS DOUBLE) AS value_6m, CAST(value_12m AS DOUBLE) AS value_12m, CAST(value_24m AS DOUBLE) AS value_24m, {_p("total", "market")} AS share_permille,
    CASE WHEN basis = 'scored' THEN least(1000, {_p("greatest(value_6m, 0)", "greatest(forward, 0)")}) END AS vulnerability10, basis AS vulnerability_basis, least(1000, {_p("greatest(expired, 0)", "greatest(total, 0)")}) AS expired_permille
    FROM (SELECT *, sum(total) OVER () AS market, CASE WHEN greatest(known, 0) * 2 < greatest(total, 0) THEN 'insufficient_coverage' WHEN greatest(forward, 0) <= 0 THEN 'no_forward_book' ELSE 'scored' END AS basis FROM (
    SELECT vendor, min(uei) AS uei, count(*) AS n_candidates, sum(value) AS total, coalesce(sum({_IN.format(180)}), 0) AS value_6m, coalesce(sum({_IN.format(365)}), 0) AS value_12m, coalesce(sum({_IN.format(730)}), 0) AS value_24m,
    coalesce(sum(value) FILTER (days_left IS NOT NULL), 0) AS known, coalesce(sum(value) FILTER (days_left < 0), 0) AS expired, coalesce(sum(value) FILTER (days_left >= 0), 0) AS forward FROM cand GROUP BY vendor))""",
)
def h1(s, d):
    return money(rollups.incumbents(cand(s, d)))


@registered(
    "h3_agencies",
    f"""SELECT agency, component, CAST(sum(value) AS DOUBLE) AS total, count(*) AS n_contracts, count({_IN.format(180)}) AS n_6m, count({_IN.format(365)}) AS n_12m, count({_IN.format(730)}) AS n_24m,
    CAST(coalesce(sum({_IN.format(730)}), 0) AS DOUBLE) AS pipeline FROM cand GROUP BY agency, component""",
)
def h3(s, d):
    return money(rollups.agencies(cand(s, d)))


@registered(
    "h4_vehicles",
    """SELECT parent_idv, count(*) AS n_orders, CAST(sum(value) AS DOUBLE) AS total, min(expiry) AS next_expiry, min_by(tier, (CASE WHEN tier = 'Data Gap' THEN 9 ELSE CAST(substr(tier, 6, 1) AS INTEGER) END, candidate_id)) AS best_tier,
    min_by(title, award_id) AS first_title FROM scored WHERE parent_idv IS NOT NULL GROUP BY parent_idv""",
)
def h4(s, d):
    return money(rollups.vehicles(scored(s, d)))


@registered(
    "h5_kpis",
    """SELECT CAST(sum(value) FILTER (days_left >= 0) AS DOUBLE) AS pipeline, count(*) AS n_candidates, count(*) FILTER (tier = 'Tier 1: Pursue Now') AS n_tier1, count(*) FILTER (days_left BETWEEN 0 AND 365) AS n_12m,
    count(*) FILTER (status = 'active') AS n_active, count(*) FILTER (status = 'expired_grace') AS n_grace, count(*) FILTER (status = 'expired_stale') AS n_stale, count(DISTINCT parent_idv) AS n_vehicles,
    quantile_cont(days_left, 0.5) FILTER (days_left >= 0) AS median_runway,
    (SELECT component FROM scored WHERE days_left >= 0 GROUP BY component ORDER BY sum(value) DESC, component LIMIT 1) AS top_component,
    (SELECT vendor FROM scored WHERE days_left BETWEEN 0 AND 365 GROUP BY vendor ORDER BY sum(value) DESC, vendor LIMIT 1) AS top_vendor FROM scored""",
)
def h5(s, d):
    return money(rollups.kpis(_staged(s, "book", scored(s, d).select("value", "days_left", "tier", "status", "parent_idv", "component", "vendor"))))


@registered(
    "h6_quality_report",
    """SELECT 'awards' AS metric, count(*) AS value, 'awards' AS category FROM award UNION ALL SELECT 'repeated_piid', count(piid) - count(DISTINCT piid), 'awards' FROM award
    UNION ALL SELECT 'without_end', count(*) FILTER (current_end IS NULL AND potential_end IS NULL), 'awards' FROM award UNION ALL SELECT 'without_uei', count(*) FILTER (uei IS NULL), 'awards' FROM award
    UNION ALL SELECT confidence, count(*), 'confidence' FROM award GROUP BY confidence
    UNION ALL SELECT CASE WHEN days_left >= -365 THEN 'under 1 year' WHEN days_left >= -1095 THEN '1 to 3 years' ELSE 'over 3 years' END, count(*), 'stale age' FROM cand WHERE days_left < -90 GROUP BY 1""",
)
def h6(s, d):
    return rollups.quality_report(awards(s, d), cand(s, d))


_f = rules.fiscal("day")


@registered(
    "h7_date_dimension",
    f"""SELECT day, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, {", ".join(f"{v} AS {k}" for k, v in _f.items())} FROM (
    SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b + 730 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT least(min(pop_start), {AS_OF}) AS a, greatest(max(expiry), {AS_OF}) AS b FROM cand))""",
)
def h7(s, d):
    return rollups.date_dimension(cand(s, d))


@registered("h8_surrogate_keys", "SELECT component, CAST(row_number() OVER (ORDER BY total DESC, component) AS INTEGER) AS component_key, n FROM (SELECT component, sum(value) AS total, count(*) AS n FROM cand GROUP BY component)")
def h8(s, d):
    dim = cand(s, d).groupBy("component").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return rollups.surrogate_keys(dim, "component", F.col("total").desc(), "component").select("component", "component_key", "n")


@registered("h9_added_codes", f"SELECT psc, CASE WHEN psc IN ({rules.listed(rules.PSC_RELEVANT)}) THEN 'lookup' ELSE 'seen in facts' END AS origin FROM (SELECT psc FROM award WHERE psc IS NOT NULL UNION SELECT unnest([{rules.listed(rules.PSC_RELEVANT)}]))")
def h9(s, d):
    lookup = s.createDataFrame([(p,) for p in rules.PSC_RELEVANT], "psc string")
    return rollups.added_codes(awards(s, d), lookup, "psc")


@registered("h10_group_sums", "SELECT bucket, phase, state, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM cand WHERE length(state) = 2 GROUP BY ALL")
def h10(s, d):
    return money(cand(s, d).where("length(state) = 2").groupBy("bucket", "phase", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@registered(
    "h10_expiry_histogram",
    """SELECT CAST(least(23, CASE WHEN b > a THEN (date_diff('day', a, expiry) * 24) // date_diff('day', a, b) ELSE 0 END) AS BIGINT) AS bin, count(*) AS n, min(expiry) AS first, max(expiry) AS last
    FROM (SELECT expiry, min(expiry) OVER () AS a, max(expiry) OVER () AS b FROM cand WHERE expiry IS NOT NULL) GROUP BY 1""",
)
def h10b(s, d):
    return rollups.expiry_histogram(cand(s, d))


@registered("h11_pareto", f"SELECT vendor, place, CAST(v AS DOUBLE) AS v, {_p('upto', 'total')} AS cumulative_permille FROM (SELECT vendor, v, row_number() OVER w AS place, sum(v) OVER w AS upto, sum(v) OVER () AS total FROM (SELECT vendor, sum(value) AS v FROM cand GROUP BY vendor) WINDOW w AS (ORDER BY v DESC, vendor ROWS UNBOUNDED PRECEDING))")
def h11(s, d):
    return money(rollups.pareto(cand(s, d)))


_CODES = ("1260", "D302", "D307", "D399", "DA01", "R425")


@registered("h12_component_by_psc", "SELECT component, " + ", ".join(f"CAST(coalesce(sum(value) FILTER (psc = '{p}'), 0) AS DOUBLE) AS \"{p}\"" for p in _CODES) + " FROM cand GROUP BY component")
def h12(s, d):
    return money(rollups.pivot_by_psc(cand(s, d), _CODES))


@registered("h13_footprint", f"SELECT vendor, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total, CAST(coalesce(sum({_IN.format(365)}), 0) AS DOUBLE) AS value_12m, count({_IN.format(365)}) AS n_12m FROM cand GROUP BY vendor")
def h13(s, d):
    return money(rollups.footprint(cand(s, d)))


_fy = rules.fiscal("signed")["fiscal_year"]


@registered("h14_by_fiscal_year", f"SELECT {_fy} AS fiscal_year, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM award WHERE signed IS NOT NULL GROUP BY 1")
def h14(s, d):
    return money(awards(s, d).where("signed is not null").groupBy(F.expr(_fy).alias("fiscal_year")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@registered(
    "h15_home_numbers",
    """SELECT CAST(coalesce(sum(value) FILTER (tier = 'Tier 1: Pursue Now' AND days_left BETWEEN 0 AND 365), 0) AS DOUBLE) AS tier1_12m, quantile_cont(days_left, 0.5) FILTER (days_left >= 0 AND tier <> 'Data Gap') AS median_runway,
    count(*) FILTER (tier = 'Data Gap') AS n_quarantined, CAST(coalesce(sum(value) FILTER (tier = 'Data Gap'), 0) AS DOUBLE) AS quarantined_value FROM scored""",
)
def h15(s, d):
    gap = F.col("tier") == "Data Gap"
    x = scored(s, d).agg(
        F.coalesce(F.sum(F.when((F.col("tier") == rules.TIERS[0][1]) & F.col("days_left").between(0, 365), F.col("value"))), rollups.zero()).alias("tier1_12m"),
        F.expr("percentile(case when days_left >= 0 and tier <> 'Data Gap' then days_left end, 0.5)").alias("median_runway"),
        F.count(F.when(gap, 1)).alias("n_quarantined"),
        F.coalesce(F.sum(F.when(gap, F.col("value"))), rollups.zero()).alias("quarantined_value"),
    )
    return money(x)


@registered("h16_board", "SELECT candidate_id, tier, CAST(days_left AS BIGINT) AS days_left FROM scored WHERE days_left >= 0 AND (tier LIKE 'Tier 1%' OR tier LIKE 'Tier 2%') ORDER BY days_left, candidate_id LIMIT 15")
def h16(s, d):
    return rollups.board(scored(s, d)).select("candidate_id", "tier", F.col("days_left").cast("long").alias("days_left"))


@registered("h16_other_contracts", "SELECT vendor, candidate_id, place FROM (SELECT vendor, candidate_id, row_number() OVER (PARTITION BY vendor ORDER BY value DESC, candidate_id) AS place FROM cand) WHERE place <= 25")
def h16b(s, d):
    return rollups.other_contracts(cand(s, d)).select("vendor", "candidate_id", F.col("place").cast("long").alias("place"))


def _sql(name: str, text: str, duck: str):
    """A query of the analyst pack as Spark SQL over the views it names."""

    def run(s, d):
        scored(s, d).createOrReplaceTempView("scored_candidates")
        awards(s, d).createOrReplaceTempView("awards_classified")
        return s.sql(text)

    registered(name, duck)(run)


def _both(name: str, text: str) -> None:
    duck = text.replace("scored_candidates", "scored").replace("awards_classified", "award").replace("percentile(score, 0.5)", "quantile_cont(score, 0.5)")
    _sql(name, text, duck)


_both("i1_expiring_by_naics", "SELECT naics, count(*) AS candidates_12m, CAST(sum(value) AS DOUBLE) AS total FROM scored_candidates WHERE status = 'active' AND days_left BETWEEN 0 AND 365 GROUP BY naics ORDER BY candidates_12m DESC, naics")
_both(
    "i2_incumbent_concentration",
    """SELECT component, count(*) AS n_incumbents, CAST(max(component_value) AS DOUBLE) AS component_value, min(CASE WHEN place = 1 THEN vendor END) AS top_incumbent, CAST(max(CASE WHEN place = 1 THEN vendor_value END) AS DOUBLE) AS top_value
    FROM (SELECT *, rank() OVER (PARTITION BY component ORDER BY vendor_value DESC) AS place, sum(vendor_value) OVER (PARTITION BY component) AS component_value
      FROM (SELECT component, vendor, sum(value) AS vendor_value FROM scored_candidates WHERE status = 'active' AND vendor IS NOT NULL GROUP BY component, vendor) v) r GROUP BY component""",
)
_both("i3_score_by_tier", "SELECT tier, count(*) AS n, min(score) AS least_score, CAST(sum(score10) AS BIGINT) AS sum_score10, percentile(score, 0.5) AS median_score, max(score) AS most_score FROM scored_candidates WHERE score IS NOT NULL GROUP BY tier")
_both(
    "i5_year_over_year",
    """SELECT award_year, n, CAST(total AS DOUBLE) AS total, CAST(lag(total) OVER (ORDER BY award_year) AS DOUBLE) AS prior, CAST(total - lag(total) OVER (ORDER BY award_year) AS DOUBLE) AS change
    FROM (SELECT CAST(extract(year FROM signed) AS INTEGER) AS award_year, count(*) AS n, sum(value) AS total FROM awards_classified WHERE signed IS NOT NULL AND value IS NOT NULL GROUP BY 1) y""",
)
_q = rules.fiscal("expiry")
_both(
    "i6_mix_by_quarter",
    f"""SELECT fiscal_label, n, n_active, n - n_active AS n_other, CAST(total AS DOUBLE) AS total, CAST(sum(total) OVER (ORDER BY fiscal_year, fiscal_quarter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running
    FROM (SELECT {_q["fiscal_year"]} AS fiscal_year, {_q["fiscal_quarter"]} AS fiscal_quarter, {_q["fiscal_label"]} AS fiscal_label, count(*) AS n, count(CASE WHEN status = 'active' THEN 1 END) AS n_active, sum(value) AS total
      FROM scored_candidates WHERE expiry IS NOT NULL GROUP BY 1, 2, 3) q""",
)
