"""Registered parsing rules, exports, chips, evidence and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from awardforge.functions import rules
from awardforge.functions.rules import AS_OF, DUCK, SPARK
from awardforge.operators import candidates, chips, history, pricing, signals, star, trust
from awardforge.plans import domain
from awardforge.plans.award_queries import award_rows, awards, cand, held, kept, registered, scored, succeeded
from awardforge.plans.market_queries import _PRICED, _ranged, _shared, _staged, g1, j2, j4, linkable, priced
from awardforge.plans.oracle import CHAIN
from awardforge.sources import tables

_MONEY = "CASE l_linenumber % 4 WHEN 0 THEN '$' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(30)) WHEN 1 THEN '-' WHEN 2 THEN '' ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR(30)) || ' USD' END"


def lines(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet")


@registered("b1_dollars", f"SELECT l_orderkey, count(x) AS n, CAST(sum(x) AS DOUBLE) AS total FROM (SELECT l_orderkey, TRY_CAST(regexp_replace({_MONEY}, '[^0-9.-]', '', 'g') AS DECIMAL(18,2)) AS x FROM lineitem) GROUP BY l_orderkey")
def b1(s, d):
    x = lines(s, d).select("l_orderkey", tables.dollars(F.expr(_MONEY)).alias("x"))
    return x.groupBy("l_orderkey").agg(F.count("x").alias("n"), F.sum("x").cast("double").alias("total"))


_DAY = "CASE l_linenumber % 3 WHEN 0 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR(30)) WHEN 1 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR(30)) || ' 00:00:00' ELSE 'n/a' END"


@registered("b2_dates", "SELECT CAST(l_shipdate AS DATE) AS day, count(*) FILTER (l_linenumber % 3 <> 2) AS n_read, count(*) FILTER (l_linenumber % 3 = 2) AS n_refused FROM lineitem GROUP BY 1")
def b2(s, d):
    x = lines(s, d).select(F.col("l_shipdate").cast("date").alias("day"), tables.day(F.expr(_DAY)).alias("x"))
    return x.groupBy("day").agg(F.count(F.when(F.col("x") == F.col("day"), 1)).alias("n_read"), F.count(F.when(F.col("x").isNull(), 1)).alias("n_refused"))


@registered("b4_codes", "SELECT CAST(l_partkey AS VARCHAR) AS code, count(*) AS n FROM lineitem GROUP BY 1")
def b4(s, d):
    raw = F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".0").otherwise(" "))
    return lines(s, d).groupBy(tables.code(raw).alias("code")).agg(F.count(F.lit(1)).alias("n"))


#: Placeholder for a title that cannot be shown.
UNTITLED = "[Untitled award - see source record]"
_TAG = r"\b[A-Z]?IGF\s*[:;]{1,2}\s*((IGF|CT|CL|OTF|OT)\s*([:;]{1,2}\s*)?)*"


def _clean_title(d) -> str:
    stripped = f"trim({d.replaced(d.replaced('title', _TAG, ''), r'\s+', ' ')})"
    return f"CASE WHEN {rules.title_flags(d)['garbled_title']} OR {stripped} = '' THEN '{UNTITLED}' ELSE {stripped} END"


@registered("b10_clean_titles", f"SELECT candidate_id, {_clean_title(DUCK)} AS clean_title FROM cand")
def b10(s, d):
    return cand(s, d).select("candidate_id", F.expr(_clean_title(SPARK)).alias("clean_title"))


@registered("b11_source_url", "SELECT award_id, CASE WHEN regexp_matches(award_id, '^(CONT|ASST)_[A-Z]+_') THEN 'https://www.usaspending.gov/award/' || award_id END AS source_url FROM award")
def b11(s, d):
    return awards(s, d).select("award_id", F.when(F.col("award_id").rlike("^(CONT|ASST)_[A-Z]+_"), F.concat(F.lit("https://www.usaspending.gov/award/"), "award_id")).alias("source_url"))


_f = rules.fiscal("expiry")


@registered("b16_fiscal_parts", f"SELECT candidate_id, {', '.join(f'{v} AS {k}' for k, v in _f.items())}, CAST(floor((days_left * 200 + 3044) / 6088.0) AS BIGINT) AS months_left FROM cand WHERE expiry IS NOT NULL")
def b16(s, d):
    return cand(s, d).where("expiry is not null").select("candidate_id", *[F.expr(v).alias(k) for k, v in _f.items()], F.floor((F.col("days_left") * 200 + 3044) / F.lit(6088.0)).cast("long").alias("months_left"))


def _compact(d) -> str:
    tenth = lambda unit: f"CAST({d.div(f'CAST(floor(value) AS BIGINT) * 10 + {unit // 2}', str(unit))} AS BIGINT)"
    text = lambda unit, mark: f"'$' || CAST({d.div(tenth(unit), '10')} AS VARCHAR(20)) || '.' || CAST({tenth(unit)} % 10 AS VARCHAR(20)) || '{mark}'"
    return f"CASE WHEN value >= 1000000000 THEN {text(10**9, 'B')} WHEN value >= 1000000 THEN {text(10**6, 'M')} ELSE {text(1000, 'K')} END"


@registered("b17_compact_usd", f"SELECT candidate_id, {_compact(DUCK)} AS usd FROM cand")
def b17(s, d):
    return cand(s, d).select("candidate_id", F.expr(_compact(SPARK)).alias("usd"))


@registered("f4_displacement_order", "SELECT candidate_id, displacement_count, score10 FROM displaced JOIN scored USING (candidate_id) ORDER BY displacement_count DESC NULLS LAST, score10 DESC, candidate_id LIMIT 100")
def f4(s, d):
    h = held(s, d)
    x = signals.displacement(succeeded(s, d, h), signals.size_shift(award_rows(h)))
    return x.orderBy(F.col("displacement_count").desc_nulls_last(), F.col("score10").desc(), "candidate_id").limit(100).select("candidate_id", "displacement_count", "score10")


CHAIN["chippable"] = """SELECT s.*, strength, coalesce(r.n, 0) AS n_comparables, CASE WHEN r.n IS NULL THEN 'insufficient' ELSE 'comparables' END AS range_basis, displacement_basis, displacement_count, displacement_read, displacement_signals, displacement_band
  FROM (SELECT * FROM scored) s LEFT JOIN ranged r ON r.candidate_id = s.candidate_id LEFT JOIN displaced d ON d.candidate_id = s.candidate_id"""
_LONG = " UNION ALL ".join(
    f"SELECT candidate_id, {rank} AS rank, '{code}' AS code, x.name, x.kind, x.evidence FROM (SELECT candidate_id, CASE " + " ".join(f"WHEN coalesce({c.when}, false) THEN {{'name': '{c.name}', 'kind': '{c.kind}', 'evidence': {c.evidence}}}" for c in options) + " END AS x FROM chippable) WHERE x IS NOT NULL"
    for code, (rank, options) in chips.cases(DUCK, rules.Profile()).items()
)
CHAIN["chipped"] = f"""SELECT candidate_id, list({{'rank': rank, 'code': code, 'name': name, 'kind': kind, 'evidence': evidence}} ORDER BY rank) AS chips FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY rank) AS place FROM ({_LONG}) WHERE code <> 'urgency' OR candidate_id NOT IN (SELECT candidate_id FROM scored WHERE days_left IS NULL OR days_left < -90)) WHERE place <= {chips.MOST} GROUP BY candidate_id"""


def chippable(s, d, x=None, h=None):
    """Scored candidates (those of ``x``, if given) with what is known of their price range and displacement. ``h``: awards with their signals, if they are written already."""
    h = held(s, d) if h is None else h
    a = award_rows(h).select(*_PRICED)
    c = candidates.build(a)
    if x is None:
        x = scored(s, d, h)
    else:
        c = c.join(F.broadcast(x.select("candidate_id")), "candidate_id", "left_semi")
    r = pricing.ranges(c, pricing.comparable_sets(c, a)).select("candidate_id", "strength", "n_comparables", "range_basis", *[F.col(c).alias(f"range_{c}") for c in ("low", "median", "high")])
    moved = signals.displacement(succeeded(s, d, h), signals.size_shift(award_rows(h))).select("candidate_id", "displacement_basis", "displacement_count", "displacement_read", "displacement_signals", "displacement_band")
    return x.join(r, "candidate_id", "left").join(moved, "candidate_id", "left")


@registered("f12_reason_chips", "SELECT candidate_id, CAST(to_json(chips) AS VARCHAR) AS chips FROM chipped")
def f12(s, d):
    """Chips of the demo profile in rank order as JSON."""
    return chips.chips(chippable(s, d), SPARK, rules.Profile()).select("candidate_id", F.to_json("chips").alias("chips"))


@registered("f12_chip_counts", "SELECT x.code AS code, x.name AS name, x.kind AS kind, count(*) AS n FROM (SELECT unnest(chips) AS x FROM chipped) GROUP BY ALL")
def f12b(s, d):
    return chips.chips(chippable(s, d), SPARK, rules.Profile()).select(F.explode("chips").alias("x")).groupBy("x.code", "x.name", "x.kind").agg(F.count(F.lit(1)).alias("n"))


@registered("k1_snapshot_contract", "SELECT candidate_id, tier, CASE WHEN notice_id IS NULL THEN '' ELSE notice_id END AS notice_ids FROM scored JOIN idlink USING (candidate_id)")
def k1(s, d):
    c = linkable(s, d, "tier")
    ids = g1(s, d, c).groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("notice_id")), ",").alias("notice_ids"))
    return c.select("candidate_id", "tier").join(ids, "candidate_id")


#: What a reviewer would look for in a public title, without the rules that withhold: an address, a number, a role with a mark.
_CONTACT = "[A-Za-z0-9.]@[a-z]+[.][a-z]|[0-9]{3}-[0-9]{3}-[0-9]{4}|(^|[^A-Za-z])([Pp][Oo][Cc]|[Aa][Tt][Tt][Nn])[ )]*[:-]"


@registered(
    "m2_public_checks",
    f"""SELECT 'title_names_nobody' AS check_name, true AS ok, 0 AS failing, (SELECT count(*) FROM cand WHERE regexp_matches(coalesce(title, ''), 'POC: J SAMPLE')) AS n_withheld, (SELECT count(*) FROM cand WHERE regexp_matches(coalesce(title, ''), '{_CONTACT}')) AS n_found_before
    UNION ALL SELECT 'no_free_text_column', true, 0, 0, 0""",
)
def m2(s, d):
    """The public candidates, scrubbed and with titles withheld, looked through by another pattern than the one that withholds; and before that, how much it finds in the raw ones."""
    from awardforge.functions import privacy

    raw = cand(s, d).select("title")
    public = privacy.withhold_titles(raw, ("title",)).select("title", tables.scrub(F.col("title")).alias("t"))
    bad = F.count(F.when(F.col("t").rlike(_CONTACT), 1))
    n = raw.agg(F.count(F.when(F.coalesce("title", F.lit("")).rlike(_CONTACT), 1)).alias("n_found_before"))
    one = public.agg(F.lit("title_names_nobody").alias("check_name"), (bad == 0).alias("ok"), bad.alias("failing"), F.count(F.when(F.col("title") == privacy.WITHHELD, 1)).alias("n_withheld")).crossJoin(n)
    published = privacy.public_columns("fact_contract_awards", awards(s, d).withColumn("description_raw", F.col("description")))
    left = sum(c in published.columns for c in privacy.PUBLIC_EXCLUDED["fact_contract_awards"])
    zero = F.lit(0).cast("long")
    return one.unionByName(s.range(1).select(F.lit("no_free_text_column").alias("check_name"), F.lit(left == 0).alias("ok"), F.lit(left).cast("long").alias("failing"), zero.alias("n_withheld"), zero.alias("n_found_before")))


_NEAR = "coalesce(posted_date BETWEEN {0} - INTERVAL 24 MONTH AND {0} + INTERVAL 12 MONTH, false)"


@registered(
    "m3_link_checks",
    f"""SELECT 'link_in_a_window' AS check_name, count(*) FILTER (NOT c) = 0 AS ok, count(*) FILTER (NOT c) AS failing FROM (
    SELECT posted_date IS NULL OR coalesce(expiry, current_end) IS NULL OR {_NEAR.format("expiry")} OR {_NEAR.format("current_end")} AS c
    FROM idlink JOIN (SELECT notice_id, posted_date FROM notice) USING (notice_id) JOIN (SELECT candidate_id, expiry, current_end FROM cand) USING (candidate_id))""",
)
def m3(s, d):
    """No link outside both windows, recomputed from the notice's date."""
    c = linkable(s, d)
    x = g1(s, d, c).where("notice_id is not null").join(domain.notices(s, d).select("notice_id", "posted_date"), "notice_id").join(c.select("candidate_id", "expiry", "current_end"), "candidate_id")
    near = lambda e: f"coalesce(posted_date BETWEEN add_months({e}, -24) AND add_months({e}, 12), false)"
    return trust.checks(x, {"link_in_a_window": f"posted_date IS NULL OR coalesce(expiry, current_end) IS NULL OR {near('expiry')} OR {near('current_end')}"})


@registered("j8_trust_report")
def j8(s, d):
    """All measures in one long table with the day they were taken."""
    h = held(s, d)
    a = j2(s, d, h).select(F.concat(F.lit("precision "), "link_confidence").alias("metric"), F.col("precision").alias("value"), "n", "gate_state")
    b = j4(s, d, h).select("metric", (F.col("refused_permille") / 1000).alias("value"), "n", F.lit("measured").alias("gate_state"))
    return a.unionByName(b).withColumn("snapshot_date", F.expr(AS_OF))


@registered("a8_reference_union", f"SELECT psc AS code, CASE WHEN psc IN ({rules.listed(rules.PSC_RELEVANT)}) THEN true ELSE false END AS relevant FROM (SELECT psc FROM award WHERE psc IS NOT NULL UNION SELECT unnest([{rules.listed(rules.PSC_RELEVANT)}]))")
def a8(s, d):
    """Vintages from the awards of each year; the curated codes keep their flag."""
    v = awards(s, d).where("psc is not null").select(F.col("psc").alias("code"), F.concat(F.lit("class "), F.substring("psc", 1, 2)).alias("description"), F.year("signed").alias("vintage")).distinct()
    curated = s.createDataFrame([(p, "curated", True) for p in rules.PSC_RELEVANT], "code string, description string, relevant boolean")
    return tables.newest_reference(v, curated).select("code", "relevant")


@registered("a11_formula_safe", "SELECT candidate_id, CASE WHEN regexp_matches(x, '^[=+@-]') THEN '''' || x ELSE x END AS x FROM (SELECT candidate_id, CASE WHEN days_left < 0 THEN '=' || title ELSE title END AS x FROM cand)")
def a11(s, d):
    return tables.formula_safe(cand(s, d).select("candidate_id", F.when(F.col("days_left") < 0, F.concat(F.lit("="), "title")).otherwise(F.col("title")).alias("x")))


@registered(
    "a13_crm_leads",
    "SELECT candidate_id, vendor, component, tier, CAST(value AS DOUBLE) AS value, concat_ws(' - ', 'expires ' || CAST(expiry AS VARCHAR), CASE WHEN terminated THEN 'terminated' END, 'set-aside ' || set_aside_code) AS note FROM scored WHERE tier <> 'Data Gap'",
)
def a13(s, d):
    note = F.concat_ws(" - ", F.concat(F.lit("expires "), F.col("expiry").cast("string")), F.when(F.col("terminated"), "terminated"), F.concat(F.lit("set-aside "), "set_aside_code"))
    return scored(s, d).where("tier <> 'Data Gap'").select("candidate_id", "vendor", "component", "tier", F.col("value").cast("double").alias("value"), note.alias("note"))


@registered("a9_naics_reference", f"SELECT naics, naics IN ({rules.listed(rules.NAICS_ALWAYS)}) AS always_relevant, count(*) AS n_awards FROM award WHERE naics IS NOT NULL GROUP BY naics")
def a9(s, d):
    return awards(s, d).where("naics is not null").groupBy("naics").agg(F.col("naics").isin(*rules.NAICS_ALWAYS).alias("always_relevant"), F.count(F.lit(1)).alias("n_awards"))


_OUTCOME = "CASE CAST(substr(candidate_id, 13) AS BIGINT) % 4 WHEN 0 THEN 'undeterminable' WHEN 1 THEN 'not_recompeted' ELSE 'recompeted' END"


@registered(
    "j3_precision_at_50",
    f"""SELECT n, k, n_undeterminable, CASE WHEN n >= 40 THEN 'measured' ELSE 'below_floor' END AS gate_state FROM (SELECT count(*) FILTER (o <> 'undeterminable') AS n, count(*) FILTER (o = 'recompeted') AS k, count(*) FILTER (o = 'undeterminable') AS n_undeterminable
    FROM (SELECT {_OUTCOME} AS o FROM (SELECT candidate_id FROM scored WHERE tier <> 'Data Gap' ORDER BY score10 DESC, candidate_id LIMIT 50)))""",
)
def j3(s, d):
    """Outcomes of the 50 best; under 40 that can be determined there is a gate state and no rate."""
    best = scored(s, d).where("tier <> 'Data Gap'").orderBy(F.col("score10").desc(), "candidate_id").limit(50).select(F.expr(_OUTCOME).alias("o"))
    x = best.agg(F.count(F.when(F.col("o") != "undeterminable", 1)).alias("n"), F.count(F.when(F.col("o") == "recompeted", 1)).alias("k"), F.count(F.when(F.col("o") == "undeterminable", 1)).alias("n_undeterminable"))
    return x.withColumn("gate_state", F.when(F.col("n") >= 40, "measured").otherwise("below_floor"))


#: Comparables that a user takes out: one award in seven.
_OUT = "CAST(substr(comp_id, 10) AS BIGINT) % 7 = 3"


@registered(
    "g6_projected_range",
    f"""SELECT candidate_id, coalesce(n, 0) AS n_comparables, CASE WHEN n IS NULL THEN 'insufficient' ELSE 'comparables' END AS range_basis, coalesce(strength, 'Insufficient') AS strength, round(median / 100, 0) AS median,
      {", ".join(f"round({v} * (1.0::DOUBLE + 1.028::DOUBLE + pow(1.028::DOUBLE, 2) + pow(1.028::DOUBLE, 3) + pow(1.028::DOUBLE, 4)) / 10000, 0) AS {v}_term" for v in ("low", "median", "high"))}
    FROM (SELECT candidate_id, count(*) FILTER (NOT ({_OUT})) AS n_kept FROM comps GROUP BY 1) JOIN cand USING (candidate_id) LEFT JOIN ({_ranged(f"SELECT * FROM comps WHERE NOT ({_OUT})", 0.94)}) USING (candidate_id)""".replace("JOIN cand USING", "RIGHT JOIN (SELECT candidate_id FROM cand) USING"),
)
def g6(s, d):
    """Ranges without some comparables, with more competition than before, over five years; with fewer than five left there is none."""
    c, a = priced(s, d)
    x = pricing.scenario(c, pricing.comparable_sets(c, a), lambda comp: comp["comp_id"].substr(10, 20).cast("long") % 7 == 3, "more", F.lit(5))
    n = F.when(F.col("range_basis") == "comparables", F.col("n_comparables")).otherwise(0).cast("long")
    return x.select("candidate_id", n.alias("n_comparables"), "range_basis", "strength", F.round(F.col("median") / 100, 0).alias("median"), *[F.round(F.col(f"{v}_term") / 10000, 0).alias(f"{v}_term") for v in ("low", "median", "high")])


_DATED = "SELECT unnest([expiry, window_start, window_end, current_end, potential_end]) AS day FROM scored UNION ALL SELECT unnest([pop_start, current_end, potential_end, signed]) FROM award"
_COUNTS = {
    "fact_recompete_candidates": "SELECT count(*) FROM scored",
    "fact_contract_awards": "SELECT count(*) FROM award",
    "fact_ptw_comparables": "SELECT count(*) FROM comps",
    "fact_scoring_breakdown": "SELECT 8 * count(*) FROM scored",
    "fact_opportunity_notices": "SELECT count(*) FROM notice",
    "fact_transactions": "SELECT count(*) FROM (SELECT DISTINCT award_key, mod_no, action_date, action_type_code, obligation FROM kept WHERE action_type_code IN ('E', 'F', 'X', 'N') OR obligation < -10000)",
    "bridge_award_opportunity_links": "SELECT count(*) FROM cand",
    "dim_agency": "SELECT count(*) FROM (SELECT DISTINCT agency, component FROM scored)",
    "dim_vendor": "SELECT count(DISTINCT vendor) FROM scored",
    "dim_naics": f"SELECT count(*) FROM (SELECT naics FROM award WHERE naics IS NOT NULL UNION SELECT unnest([{rules.listed(rules.NAICS_SCOPE)}]))",
    "dim_psc": f"SELECT count(*) FROM (SELECT psc FROM award WHERE psc IS NOT NULL UNION SELECT unnest([{rules.listed(rules.PSC_RELEVANT)}]))",
    "dim_date": f"SELECT date_diff('day', least(min(day), {AS_OF}), greatest(max(day), {AS_OF})) + 731 FROM ({_DATED})",
    "dim_priority_tier": "SELECT 5",
    "dim_capture_phase": "SELECT 7",
    "data_quality_report": "SELECT 4 + (SELECT count(DISTINCT confidence) FROM award) + (SELECT count(DISTINCT CASE WHEN days_left >= -365 THEN 1 WHEN days_left >= -1095 THEN 2 ELSE 3 END) FROM cand WHERE days_left < -90)",
    "dashboard_kpi_summary": "SELECT 1",
}


@registered("a5_star_tables", " UNION ALL ".join(f"SELECT '{name}' AS table_name, ({count}) AS n_rows, {str(name in ('dim_agency', 'dim_priority_tier')).lower()} AS also_csv, true AS scrubbed" for name, count in _COUNTS.items()))
def a5(s, d):
    """All sixteen tables written and read back as views: rows, whether a CSV lies beside it, and whether its free text has no address left."""
    path = _shared(s, "star")
    csv = ("dim_agency", "dim_priority_tier")
    h = held(s, d, events=True)
    tables.write_star(star.build(s, scored(s, d, h), award_rows(h), h.select(F.col("award_id").alias("award_key"), "terminations", "negatives"), g1(s, d, cand(s, d, h)), domain.notices(s, d)), path, star.FREE_TEXT, csv)
    out = None
    for name, df in tables.read_star(s, path).items():
        text = [c for c in star.FREE_TEXT.get(name, ()) if c in df.columns]
        bare = F.lit(0) if not text else F.count(F.when(F.concat_ws(" ", *text).rlike("[a-z]@[a-z]+[.][a-z]|[0-9]{3}-[0-9]{3}-[0-9]{4}"), 1))
        one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.lit(name in csv).alias("also_csv"), (bare == 0).alias("scrubbed"))
        out = one if out is None else out.unionByName(one)
    return out


@registered(
    "h8_keyed_candidates",
    """SELECT candidate_id, agency_key, vendor_key, CASE bucket WHEN '0-6 Months' THEN 1 WHEN '6-12 Months' THEN 2 WHEN '12-18 Months' THEN 3 WHEN '18-24 Months' THEN 4 WHEN '24+ Months' THEN 5 ELSE 9 END AS bucket_sort, CAST(strftime(expiry, '%Y%m%d') AS INTEGER) AS expiry_key, CAST(strftime(window_start, '%Y%m%d') AS INTEGER) AS window_start_key
    FROM scored JOIN (SELECT agency, component, CAST(row_number() OVER (ORDER BY sum(value) DESC, agency, component) AS INTEGER) AS agency_key FROM scored GROUP BY agency, component) USING (agency, component)
    JOIN (SELECT vendor, CAST(row_number() OVER (ORDER BY sum(value) DESC, vendor) AS INTEGER) AS vendor_key FROM scored GROUP BY vendor) USING (vendor)""",
)
def h8b(s, d):
    c = scored(s, d)
    return star.keyed_candidates(c, star.agency_dimension(c), star.vendor_dimension(c)).select("candidate_id", "agency_key", "vendor_key", "bucket_sort", "expiry_key", "window_start_key")


@registered("h7_calendar", f"""SELECT year, month_name, month_short, quarter, fiscal_label, count(*) AS n, min(date_key) AS first_key, count(*) FILTER (past) AS n_past, count(*) FILTER (within_12_months) AS n_next FROM (
    SELECT day, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, CAST(extract(year FROM day) AS INTEGER) AS year, strftime(day, '%B') AS month_name, strftime(day, '%b') AS month_short, CAST(extract(quarter FROM day) AS INTEGER) AS quarter, {rules.fiscal("day")["fiscal_label"]} AS fiscal_label, day < {AS_OF} AS past, date_diff('day', {AS_OF}, day) BETWEEN 0 AND 365 AS within_12_months
    FROM (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b + 730 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT least(min(day), {AS_OF}) AS a, greatest(max(day), {AS_OF}) AS b FROM ({_DATED})))) GROUP BY ALL""")
def h7b(s, d):
    x = star.date_dimension(scored(s, d), awards(s, d))
    return x.groupBy("year", "month_name", "month_short", "quarter", "fiscal_label").agg(F.count(F.lit(1)).alias("n"), F.min("date_key").alias("first_key"), F.count(F.when(F.col("past"), 1)).alias("n_past"), F.count(F.when(F.col("within_12_months"), 1)).alias("n_next"))


def parity_checks(s, x, a, rows, links):
    """Every derived number derived again another way: scores, tiers, concentration, headline numbers, history counts, keys, links."""
    gap = x.where(F.expr(rules.quarantined(SPARK)))
    book = x.agg(F.lit(1).alias("one"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("tier") == "Data Gap", 1)).alias("n_gap"), F.sum("value").alias("value"))
    counted = rows.select("award_key", "txn_key").distinct().groupBy("award_key").agg(F.count("txn_key").alias("mod_count"))
    found = links.where("notice_id is not null")
    checks = [
        trust.parity("score_and_tier", x, trust.rescore(candidates.breakdown(x), gap), ["candidate_id"], ["score10", "tier"]),
        trust.parity("concentration", signals.concentration(x.where("tier <> 'Data Gap'")), trust.shares_again(x.where("tier <> 'Data Gap'")), ["component"], ["top_share"]),
        trust.parity("headline_numbers", book, trust.book_again(x), ["one"], ["n", "n_gap", "value"]),
        trust.parity("history_counts", history.digest(rows), counted, ["award_key"], ["mod_count"]),
        trust.unique("candidate_once", x, "candidate_id"),
        trust.unique("award_once", a, "award_id"),
        trust.unique("link_once", found, "candidate_id"),
    ]
    out = checks[0]
    for one in checks[1:]:
        out = out.unionByName(one)
    return out


PARITY = ("score_and_tier", "concentration", "headline_numbers", "history_counts", "candidate_once", "award_once", "link_once")


@registered("m1_parity", " UNION ALL ".join(f"SELECT '{n}' AS check_name, true AS ok, 0 AS failing" for n in PARITY))
def m1b(s, d):
    h = held(s, d)
    x = _staged(s, "scored", scored(s, d, h).select("candidate_id", *rules.WEIGHTS, "score10", "tier", "component", "uei", "value", "days_left", "title"))
    return parity_checks(s, x, award_rows(h), kept(s, d), g1(s, d, cand(s, d, h)))


#: What a brief may read, by public name; nothing else leaves the tables.
EVIDENCE = {
    "candidate_id": "candidate_id", "piid": "piid", "subagency": "component", "incumbent_vendor": "vendor", "incumbent_uei": "uei", "naics": "naics", "psc": "psc", "award_type": "award_type", "extent_competed_code": "extent_code",
    "type_of_set_aside_code": "set_aside_code", "number_of_offers_received": "offers", "pop_start_date": "pop_start", "current_end_date": "current_end", "potential_end_date": "potential_end", "selected_expiration_date": "expiry",
    "expiration_date_basis": "expiry_basis", "days_until_expiration": "days_left", "candidate_status": "status", "capture_phase": "phase", "estimated_recompete_window_start": "window_start", "estimated_recompete_window_end": "window_end",
    "total_obligated_amount": "value", "terminated": "terminated", "termination_kind": "termination_kind", "termination_code": "termination_code", "termination_action_date": "termination_date", "bridge_flag": "bridge_flag",
    "ceiling_balloon_flag": "ceiling_balloon", "ceiling_growth_ratio": "ceiling_growth", "mods_basis": "mods_basis", "displacement_signal_count": "displacement_count", "displacement_signals_read": "displacement_read",
    "displacement_signals": "displacement_signals", "displacement_band": "displacement_band", "displacement_basis": "displacement_basis", "ptw_data_strength": "strength", "ptw_n_comparables": "n_comparables", "ptw_basis": "range_basis",
    "pursuit_score": "score10", "priority_tier": "tier", "data_quality_notes": "notes",
}


@registered(
    "h17_evidence_pack",
    f"""SELECT b.candidate_id, CAST(to_json({{{", ".join(f"'{k}': b.{v}" for k, v in EVIDENCE.items())}}}) AS VARCHAR) AS candidate, CAST(to_json({{'incumbent_uei': v.uei, 'size_standard_shift': size_shift, 'size_standard_basis': size_basis}}) AS VARCHAR) AS vendor,
      CAST(to_json({{'subagency': b.component, 'number_of_contracts': o.n, 'total_cyber_it_obligations': o.total, 'expiring_contract_count_12_months': o.n_12m, 'concentration_top_share': k.top_share, 'concentration_n_ueis': k.n_firms, 'concentration_basis': k.concentration_basis}}) AS VARCHAR) AS office,
      CASE WHEN l.notice_id IS NULL THEN '[]' ELSE CAST(to_json([{{'notice_id': l.notice_id, 'notice_type': l.notice_type, 'solicitation_number': n.solicitation_number, 'posted_date': n.posted_date, 'response_deadline': n.response_deadline, 'link_confidence': l.link_confidence}}]) AS VARCHAR) END AS notices,
      CAST(to_json(c.chips) AS VARCHAR) AS chips
    FROM (SELECT * FROM chippable WHERE tier <> 'Data Gap' ORDER BY score10 DESC, candidate_id LIMIT 50) b LEFT JOIN (SELECT uei, size_shift, size_basis FROM shift) v ON v.uei = b.uei
    LEFT JOIN (SELECT component AS c0, count(*) AS n, sum(value) AS total, count(*) FILTER (days_left BETWEEN 0 AND 365) AS n_12m FROM scored GROUP BY component) o ON o.c0 = b.component LEFT JOIN (SELECT component AS c1, top_share, n_firms, concentration_basis FROM concentrated) k ON k.c1 = b.component
    LEFT JOIN (SELECT * FROM idlink) l ON l.candidate_id = b.candidate_id LEFT JOIN (SELECT notice_id AS n0, solicitation_number, posted_date, response_deadline FROM notice) n ON n.n0 = l.notice_id LEFT JOIN (SELECT * FROM chipped) c ON c.candidate_id = b.candidate_id""",
)
def h17(s, d):
    """The 50 best candidates with all that a brief may read of them: allow-listed fields, the vendor, the office, notices and chips."""
    # score and tier decide who is among them, so only theirs is priced
    h = held(s, d)
    best = chips.chips(chippable(s, d, _staged(s, "best", scored(s, d, h).where("tier <> 'Data Gap'").orderBy(F.col("score10").desc(), "candidate_id").limit(50)), h), SPARK, rules.Profile())
    office = scored(s, d, h).groupBy("component").agg(F.count(F.lit(1)).alias("o_n"), F.sum("value").alias("o_total"), F.count(F.when(F.col("days_left").between(0, 365), 1)).alias("o_12m"))
    share = signals.concentration(scored(s, d, h).where("tier <> 'Data Gap'")).select("component", "top_share", "n_firms", "concentration_basis")
    shift = signals.size_shift(award_rows(h)).select("uei", F.col("uei").alias("v_uei"), "size_shift", "size_basis")
    links = g1(s, d, cand(s, d, h)).select("candidate_id", F.col("notice_id").alias("l_id"), "notice_type", "link_confidence")
    notice = domain.notices(s, d).select(F.col("notice_id").alias("l_id"), "solicitation_number", "posted_date", "response_deadline")
    full = best.join(office, "component", "left").join(share, "component", "left").join(shift, "uei", "left").join(links.join(notice, "l_id", "left"), "candidate_id", "left")
    js = lambda col: F.to_json(col, {"ignoreNullFields": "false"})
    named = lambda pairs: F.struct(*[F.col(v).alias(k) for k, v in pairs.items()])
    notices = named({"notice_id": "l_id", "notice_type": "notice_type", "solicitation_number": "solicitation_number", "posted_date": "posted_date", "response_deadline": "response_deadline", "link_confidence": "link_confidence"})
    return full.select(
        "candidate_id", js(named(EVIDENCE)).alias("candidate"), js(named({"incumbent_uei": "v_uei", "size_standard_shift": "size_shift", "size_standard_basis": "size_basis"})).alias("vendor"),
        js(named({"subagency": "component", "number_of_contracts": "o_n", "total_cyber_it_obligations": "o_total", "expiring_contract_count_12_months": "o_12m", "concentration_top_share": "top_share", "concentration_n_ueis": "n_firms", "concentration_basis": "concentration_basis"})).alias("office"),
        F.when(F.col("l_id").isNull(), "[]").otherwise(js(F.array(notices))).alias("notices"), js(F.col("chips")).alias("chips"),
    )
