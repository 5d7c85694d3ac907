"""Row rules as SQL expressions for either dialect.

Amounts are decimals and scores whole tenths until the last step, so that no result depends on the
order of rows or on how an engine rounds doubles; halves round up. A missing input gives NULL and a
named basis, never a neutral value.
"""

from __future__ import annotations

from dataclasses import dataclass

# Codes, bounds, labels and words of the domain.
AS_OF = "DATE '2000-01-01'"
NAICS_ALWAYS = ("541511", "541512", "541513", "541519", "518210")
NAICS_SCOPE = (*NAICS_ALWAYS, "541611", "541330", "541690")
PSC_RELEVANT = ("D302", "D307", "D399", "DA01")
MIN_AWARD = 250_000
CYBER_WORDS = (
    "cybersecurity", "cyber security", "cyber", "information assurance", "ia", "security operations", "soc", "security operations center", "incident response",
    "threat hunting", "vulnerability management", "penetration testing", "zero trust", "rmf", "risk management framework", "nist", "cmmc", "fisma", "fedramp",
    "continuous monitoring", "siem", "endpoint detection", "edr", "identity and access management", "iam", "privileged access", "cloud security", "network security",
    "data protection", "cyber defense", "cyber operations", "security compliance", "ato", "authority to operate",
)
IT_WORDS = (
    "information technology", "it support", "help desk", "service desk", "network operations", "systems administration", "system administrator", "cloud migration",
    "cloud services", "software development", "application development", "devsecops", "data analytics", "database administration", "enterprise architecture",
    "it modernization", "infrastructure support", "telecom", "managed services", "data center", "end user support",
)
TOPICS = {
    "cyber_flag": CYBER_WORDS,
    "it_services_flag": IT_WORDS,
    "cloud_flag": ("cloud",),
    "data_analytics_flag": ("data analytics", "database"),
    "software_dev_flag": ("software development", "application development", "devsecops"),
    "network_ops_flag": ("network",),
    "help_desk_flag": ("help desk", "service desk"),
    "compliance_security_flag": ("cmmc", "nist", "fisma", "fedramp", "rmf", "ato", "authority to operate"),
}
WEIGHTS = {"capability": 25, "urgency": 20, "value_fit": 15, "agency_fit": 10, "set_aside_fit": 10, "confidence_fit": 10, "location_fit": 5, "quality_fit": 5}
TIERS = ((800, "Tier 1: Pursue Now"), (650, "Tier 2: Capture Research"), (500, "Tier 3: Monitor"), (0, "Tier 4: Low Priority"))
BUCKETS = ((182, "0-6 Months"), (365, "6-12 Months"), (548, "12-18 Months"), (730, "18-24 Months"))
PHASES = ((90, "Proposal / Submit"), (180, "Proposal Prep"), (365, "Capture Planning"), (540, "Pre-RFP Shaping"))
VEHICLE_TYPES = ("IDIQ", "BPA", "GWAC", "FSS", "BOA", "IDC", "IDV")


@dataclass(frozen=True)
class Profile:
    """A firm to score for."""

    name: str = "demo"
    naics: tuple[str, ...] = ("541512", "541519")
    psc: tuple[str, ...] = ("D302", "D307")
    capabilities: tuple[str, ...] = ("cyber", "cloud", "help desk")
    ceiling: int | None = 20_000_000
    components: tuple[str, ...] = ("NATION_1", "NATION_2", "NATION_3")
    states: tuple[str, ...] = ("VA", "MD", "DC")
    nationwide: bool = False


@dataclass(frozen=True)
class Dialect:
    name: str

    def days(self, later: str, earlier: str) -> str:
        return f"datediff({later}, {earlier})" if self.name == "spark" else f"date_diff('day', {earlier}, {later})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.name == "spark" else f"(({a}) // ({b}))"

    def matches(self, text: str, pattern: str) -> str:
        if self.name == "spark":
            return f"rlike({text}, '{pattern.replace(chr(92), chr(92) * 2)}')"
        return f"regexp_matches({text}, '{pattern}')"

    def replaced(self, text: str, pattern: str, to: str) -> str:
        if self.name == "spark":
            return f"regexp_replace({text}, '{pattern.replace(chr(92), chr(92) * 2)}', '{to}')"
        return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def listed(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def any_word(words) -> str:
    return r"\b(" + "|".join(sorted(words)) + r")\b"


def steps(value: str, bounds, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {b} THEN '{name}'" for b, name in bounds) + f" ELSE '{last}' END"


def normal_name(d: Dialect, x: str, vendor: bool = False) -> str:
    tidy = f"upper(trim({d.replaced(f'coalesce({x}, {chr(39) * 2})', r'\s+', ' ')}))"
    if vendor:
        tidy = f"trim({d.replaced(tidy, '[.,]+$', '')})"
    return f"CASE WHEN {tidy} = '' THEN 'UNKNOWN' ELSE {tidy} END"


def classification(d: Dialect) -> dict[str, str]:
    text = "lower(coalesce(description, ''))"
    out = {name: d.matches(text, any_word(words)) for name, words in TOPICS.items()}
    naics, psc, word = f"coalesce(naics IN ({listed(NAICS_ALWAYS)}), false)", f"coalesce(psc IN ({listed(PSC_RELEVANT)}), false)", d.matches(text, any_word((*CYBER_WORDS, *IT_WORDS)))
    n = f"(CASE WHEN {naics} THEN 1 ELSE 0 END + CASE WHEN {psc} THEN 1 ELSE 0 END + CASE WHEN {word} THEN 1 ELSE 0 END)"
    out["signals"] = f"CAST({n} AS INTEGER)"
    out["confidence"] = f"CASE {n} WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Not Classified' END"
    out["cyber_it_flag"] = f"{n} > 0"
    return out


def expiry(policy: str = "potential") -> tuple[str, str]:
    first, second = ("current_end", "potential_end") if policy == "current" else ("potential_end", "current_end")
    if policy == "earliest":
        chosen = "least(coalesce(current_end, potential_end), coalesce(potential_end, current_end))"
        return chosen, "CASE WHEN current_end IS NULL AND potential_end IS NULL THEN 'unknown' WHEN potential_end IS NULL OR current_end <= potential_end THEN 'current_end_date' ELSE 'potential_end_date' END"
    return f"coalesce({first}, {second})", f"CASE WHEN {first} IS NOT NULL THEN '{first}_date' WHEN {second} IS NOT NULL THEN '{second}_date' ELSE 'unknown' END"


def status(days: str = "days_left") -> str:
    return f"CASE WHEN {days} IS NULL OR {days} < -90 THEN 'expired_stale' WHEN {days} < 0 THEN 'expired_grace' ELSE 'active' END"


def bucket(days: str = "days_left") -> str:
    return f"CASE WHEN {days} IS NULL OR {days} < 0 THEN 'Expired - verify' ELSE {steps(days, BUCKETS, '24+ Months')} END"


def phase(days: str = "days_left") -> str:
    return f"CASE WHEN {days} IS NULL THEN 'Unknown / Data Gap' WHEN {days} < 0 THEN 'Expired' ELSE {steps(days, PHASES, 'Early Watch')} END"


def title_flags(d: Dialect, title: str = "title", days: str = "days_left") -> dict[str, str]:
    t = f"coalesce({title}, '')"
    bangs = f"(length({t}) - length(replace({t}, '!', '')))"
    garbled = f"({d.matches(t, '^[0-9]{6}!')} OR {bangs} >= 2 OR length({t}) > 400 OR length({d.replaced(t, '[^A-Za-z0-9]', '')}) < 4)"
    return {
        "garbled_title": garbled,
        "code_prefix": d.matches(t, r"\b[A-Z]?IGF\s*[:;]"),
        "short_title": f"length(trim({t})) < 10",
        "stale_expiration": f"coalesce({days} < -90, false)",
        "missing_end_date": f"{days} IS NULL",
    }


def score_parts(d: Dialect, p: Profile) -> dict[str, str]:
    """Each component in tenths."""
    hits = " + ".join(f"CASE WHEN contains(lower(coalesce(title, '')), '{c}') THEN 1 ELSE 0 END" for c in p.capabilities)
    capability = f"CASE WHEN naics IN ({listed(p.naics)}) THEN 400 ELSE 0 END + CASE WHEN psc IN ({listed(p.psc)}) THEN 300 ELSE 0 END + least(150 * ({hits}), 300)"
    urgency = (
        f"CASE WHEN days_left IS NULL OR days_left < -90 THEN 0 WHEN days_left >= 730 THEN 100 "
        f"WHEN days_left >= 0 THEN {d.div('2 * (730000 - days_left * 900) + 730', '1460')} ELSE {d.div('2 * (84550 - (-days_left - 1) * 350) + 89', '178')} END"
    )
    if p.ceiling:
        value = f"CASE WHEN value IS NULL OR value = 0 THEN 0 WHEN value * 10 < {p.ceiling} THEN 300 WHEN value <= {p.ceiling} THEN 1000 WHEN value <= {3 * p.ceiling} THEN 600 ELSE 250 END"
    else:
        value = "CASE WHEN value IS NULL OR value = 0 THEN 0 ELSE 500 END"
    confidence = "CASE expiry_basis WHEN 'potential_end_date' THEN 100 WHEN 'current_end_date' THEN 75 ELSE 0 END + CASE confidence WHEN 'High' THEN 100 WHEN 'Medium' THEN 65 WHEN 'Low' THEN 35 ELSE 0 END"
    flags = " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in title_flags(d).values())
    return {
        "capability": f"({capability})",
        "urgency": urgency,
        "value_fit": value,
        "agency_fit": f"CASE WHEN upper(trim(component)) IN ({listed(p.components)}) THEN 1000 ELSE 500 END",
        "set_aside_fit": "CASE WHEN coalesce(upper(trim(set_aside_code)), '') NOT IN ('', 'NONE') THEN 700 WHEN upper(trim(extent_code)) IN ('A', 'D', 'F') THEN 550 ELSE 500 END",
        "confidence_fit": f"(({confidence}) * 5)",
        "location_fit": "1000" if p.nationwide else f"CASE WHEN state IN ({listed(p.states)}) THEN 1000 ELSE 300 END",
        "quality_fit": f"greatest(700 - 200 * n_notes - 150 * ({flags}), 200)",
    }


def total_score(d: Dialect) -> str:
    """Weighted sum of the components, in tenths."""
    return d.div(" + ".join(f"{w} * {c}" for c, w in WEIGHTS.items()) + " + 50", "100")


def quarantined(d: Dialect) -> str:
    return f"(days_left IS NULL OR days_left < -90 OR {title_flags(d)['garbled_title']})"


def tier(d: Dialect, score: str = "score10") -> str:
    return f"CASE WHEN {quarantined(d)} THEN 'Data Gap' " + " ".join(f"WHEN {score} >= {b} THEN '{name}'" for b, name in TIERS[:-1]) + f" ELSE '{TIERS[-1][1]}' END"


def pace(d: Dialect, today: str = AS_OF) -> dict[str, str]:
    """Share spent against share of time gone, in ten-thousandths; the first gate that fails names the basis."""
    readable = f"coalesce(upper(trim(award_type)), '') NOT IN ({listed(VEHICLE_TYPES)}) AND base_value > 0 AND value >= 0"
    ratio = f"CASE WHEN {readable} THEN CAST({d.div('CAST(value * 100 AS BIGINT) * 20000 + CAST(base_value * 100 AS BIGINT)', 'CAST(base_value * 100 AS BIGINT) * 2')} AS BIGINT) END"
    planned, gone = d.days("potential_end", "pop_start"), d.days(today, "pop_start")
    window = f"potential_end IS NOT NULL AND pop_start IS NOT NULL AND {planned} BETWEEN 30 AND 10950 AND {gone} BETWEEN 0 AND {planned}"
    basis = f"CASE WHEN burn IS NULL OR NOT coalesce({window}, false) THEN 'insufficient' WHEN burn > 10500 THEN 'ceiling_exceeded' WHEN burn >= 9800 THEN 'fully_funded' ELSE 'measured' END"
    pressure = f"CASE WHEN pace_basis = 'measured' THEN burn - CAST({d.div(f'CAST({gone} AS BIGINT) * 20000 + {planned}', f'{planned} * 2')} AS BIGINT) END"
    band = "CASE WHEN pressure IS NULL THEN 'n/a' WHEN pressure > 2000 THEN 'burning_hot' WHEN pressure < -2000 THEN 'underutilized' ELSE 'on_pace' END"
    return {"burn": ratio, "pace_basis": basis, "pressure": pressure, "pace_band": band}


def eligibility(certs: dict[str, bool], exit_date: str | None, today: str = AS_OF) -> str:
    """Whether a firm may bid under a set-aside code: NULL-free, unknown codes are included."""
    code = "upper(trim(coalesce(set_aside_code, '')))"
    yes = lambda k: str(bool(certs.get(k))).lower()
    eight = f"({yes('8a')} AND {f'{today} <= {exit_date}' if exit_date else 'true'})"
    return (
        f"CASE WHEN {code} IN ('', 'NONE') THEN true WHEN {code} LIKE '8A%' THEN {eight} WHEN {code} LIKE 'HZ%' OR {code} LIKE '%HUBZONE%' THEN {yes('hubzone')} "
        f"WHEN {code} LIKE 'SDVOSB%' THEN {yes('sdvosb')} WHEN {code} LIKE 'EDWOSB%' THEN {yes('edwosb')} WHEN {code} LIKE 'WOSB%' THEN {yes('wosb')} OR {yes('edwosb')} "
        f"WHEN {code} LIKE 'VSA%' OR {code} LIKE 'VOSB%' THEN {yes('vosb')} OR {yes('sdvosb')} WHEN {code} LIKE 'SBA%' OR {code} LIKE 'SBP%' THEN {yes('small')} ELSE true END"
    )


def fiscal(date: str) -> dict[str, str]:
    """US federal fiscal year and quarter: the year begins in October."""
    month, year = f"CAST(extract(month FROM {date}) AS INTEGER)", f"CAST(extract(year FROM {date}) AS INTEGER)"
    q = f"CASE WHEN {month} >= 10 THEN 1 WHEN {month} <= 3 THEN 2 WHEN {month} <= 6 THEN 3 ELSE 4 END"
    y = f"({year} + CASE WHEN {month} >= 10 THEN 1 ELSE 0 END)"
    return {"fiscal_year": y, "fiscal_quarter": q, "fiscal_label": f"'FY' || CAST({y} AS VARCHAR(10)) || ' Q' || CAST({q} AS VARCHAR(10))"}
