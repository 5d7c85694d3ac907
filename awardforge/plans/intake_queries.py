"""Registered queries of notice intake, privacy, certifications and comparable snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from awardforge.functions import privacy, rules
from awardforge.functions.rules import AS_OF
from awardforge.operators import trust
from awardforge.plans import domain
from awardforge.plans.award_queries import awards, registered
from awardforge.plans.market_queries import _DAYS, _on, _shared, _snapshots
from awardforge.sources import notices

_N = "CAST(substr(notice_id, 2) AS BIGINT)"
_RAW = f"""SELECT *, CASE {_N} % 3 WHEN 0 THEN '236118' WHEN 1 THEN ' 541512 ' ELSE '541511' END AS raw_naics, CASE {_N} % 5 WHEN 0 THEN 'DEPT OF ENERGY' WHEN 1 THEN 'Department of Defense' ELSE agency END AS raw_agency,
  CASE {_N} % 4 WHEN 0 THEN CAST(posted_date AS VARCHAR(20)) || ' 10:11:12.5-04' WHEN 1 THEN CAST(posted_date AS VARCHAR(20)) || 'T01:02:03-07:00' WHEN 2 THEN CAST(posted_date AS VARCHAR(20)) ELSE 'soon' END AS raw_posted FROM notice"""


def _raw(s, d):
    domain.notices(s, d).createOrReplaceTempView("notice")
    return s.sql(_RAW)


@registered(
    "a2_notice_scan",
    f"""SELECT notice_id, title, trim(raw_naics) AS naics, raw_agency AS agency, CASE WHEN {_N} % 4 = 3 THEN '' ELSE CAST(posted_date AS VARCHAR) END AS posted_date, CAST(response_deadline AS VARCHAR) AS response_deadline, coalesce(set_aside_code, '') AS set_aside_code
    FROM ({_RAW}) WHERE trim(raw_naics) IN ({rules.listed(rules.NAICS_SCOPE)}) AND upper(raw_agency) LIKE '%DEFENSE%'""",
)
def a2(s, d):
    """Notices written as a bulk export and scanned back."""
    own = {"NoticeId": "notice_id", "Sol#": "solicitation_number", "Title": "title", "Type": "notice_type", "PostedDate": "raw_posted", "ResponseDeadLine": "response_deadline", "Department/Ind.Agency": "raw_agency", "NaicsCode": "raw_naics", "SetASideCode": "set_aside_code", "PopState": "state"}
    path = _shared(s, "notice-csv")
    columns = [(F.col(own[c]).cast("string") if c in own else F.lit(None).cast("string")).alias(c) for c in notices.NOTICE_COLUMNS]
    _raw(s, d).select(*columns).write.option("header", True).option("escape", '"').csv(path)
    return notices.scan_notices(s, path).select("notice_id", "title", "naics", "agency", "posted_date", "response_deadline", "set_aside_code")


@registered(
    "a3_notice_records",
    f"""SELECT notice_id, title, CASE {_N} % 5 WHEN 0 THEN '541512' WHEN 1 THEN '541513' WHEN 2 THEN '518210' WHEN 3 THEN '541611' END AS naics,
    CASE {_N} % 5 WHEN 0 THEN 'DEPT OF DEFENSE' WHEN 1 THEN 'ENERGY' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'DEPARTMENT OF DEFENSE' ELSE 'A' END AS agency,
    CASE {_N} % 5 WHEN 0 THEN 'VA' WHEN 1 THEN 'OHIO' WHEN 2 THEN 'TX' WHEN 3 THEN 'VA' END AS place_of_performance_state, CAST(posted_date AS VARCHAR) AS posted_date FROM notice""",
)
def a3(s, d):
    """Live records of several shapes and normalised ones, as JSON texts."""
    domain.notices(s, d).createOrReplaceTempView("notice")
    text = s.sql(
        f"""SELECT CASE {_N} % 5
        WHEN 0 THEN to_json(named_struct('noticeId', notice_id, 'title', title, 'naicsCode', '541512', 'fullParentPathName', 'Dept of Defense.Dept of the Army', 'placeOfPerformance', named_struct('state', named_struct('code', 'va', 'name', 'Virginia')), 'postedDate', CAST(posted_date AS STRING)))
        WHEN 1 THEN to_json(named_struct('noticeId', notice_id, 'title', title, 'naics', array(named_struct('code', '541513'), named_struct('code', '1')), 'department', 'Energy', 'placeOfPerformance', named_struct('state', named_struct('name', 'Ohio')), 'postedDate', CAST(posted_date AS STRING)))
        WHEN 2 THEN to_json(named_struct('noticeId', notice_id, 'title', title, 'naics', array('518210', '2'), 'placeOfPerformance', named_struct('state', 'tx'), 'postedDate', CAST(posted_date AS STRING)))
        WHEN 3 THEN to_json(named_struct('notice_id', notice_id, 'title', title, 'naics', '541611', 'agency', agency, 'place_of_performance_state', 'va', 'posted_date', CAST(posted_date AS STRING)))
        ELSE to_json(named_struct('noticeId', notice_id, 'title', title, 'fullParentPathName', ' a .b', 'postedDate', CAST(posted_date AS STRING))) END AS record FROM notice"""
    )
    return notices.from_json_records(text).select("notice_id", "title", "naics", "agency", "place_of_performance_state", "posted_date")


_K = "CAST(substr(award_id, 10) AS BIGINT)"
_SAYS = [
    "Router upkeep, poc: Q Tester", "Attn - M. Placeholder", "Co-locate two racks", "PKS/Dummyname/Fillin storage", "PKA wing audit", "N102C Fillin tooling", "Move COR to Placeholder",
    "A proof of concept (POC) trial", "Point of contact (TPOC): Tester", "PKP FY23 refresh", "Base/PK Dummyname laptops", "Fillin:Tester desk order", "IGF:OT desk order", "Contract specialist: Q Tester", "Dummyname/Fillin/PKAB cables", "PKG of twelve", "Note: spare parts", "PKB - Dummy - Fillin radios", "PK: RISK study", "",
]
_NAMED = (0, 1, 3, 5, 6, 8, 10, 11, 13, 14, 17)
_TITLE = f"CASE {_K} % {len(_SAYS)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_SAYS)) + " END || ' ' || award_id"


@registered("b7_withheld_titles", f"SELECT award_id, CASE WHEN {_K} % {len(_SAYS)} IN ({', '.join(map(str, _NAMED))}) THEN '{privacy.WITHHELD}' ELSE {_TITLE} END AS title FROM award")
def b7(s, d):
    return privacy.withhold_titles(awards(s, d).select("award_id", F.expr(_TITLE).alias("title")), ("title",))


@registered("b8_public_columns", "SELECT award_id, vendor, CAST(value AS DOUBLE) AS value FROM award")
def b8(s, d):
    """The awards table as published: its free-text columns are gone."""
    a = awards(s, d).select("award_id", "vendor", F.col("value").cast("double").alias("value"), F.col("description").alias("description_raw"), F.lit("why").alias("classification_reason"))
    return privacy.public_columns("fact_contract_awards", a)


_TYPES = """CASE c_custkey % 6 WHEN 0 THEN '{"sbaBusinessTypeList":[{"sbaBusinessTypeDesc":"SBA Certified 8(a) Program Participant","certificationExitDate":"2001-02-03T00:00:00"},{"sbaBusinessTypeDesc":"SBA Certified HUBZone Firm"}]}'
  WHEN 1 THEN '{"businessTypeList":[{"businessTypeDesc":"Economically Disadvantaged Women-Owned Small Business"},{"businessTypeDesc":"Veteran-Owned Business"}]}'
  WHEN 2 THEN '{"businessTypeList":[{"businessTypeDesc":"Service-Disabled Veteran-Owned Business"}],"sbaBusinessTypeList":[{"sbaBusinessTypeDesc":"SBA 8(a) Joint Venture"}]}'
  WHEN 3 THEN '{"sbaBusinessTypeList":null}' WHEN 4 THEN '{"businessTypeList":[{"businessTypeDesc":"Women-Owned Small Business"}]}' END"""


@registered(
    "f11_certifications",
    """SELECT c_custkey, coalesce(c_custkey % 6 = 0, false) AS is_8a, CASE WHEN c_custkey % 6 = 0 THEN DATE '2001-02-03' END AS program_exit_date_8a, c_custkey % 6 = 0 AS is_hubzone, c_custkey % 6 IN (1, 4) AS is_wosb,
    c_custkey % 6 = 1 AS is_edwosb, c_custkey % 6 = 2 AS is_sdvosb, c_custkey % 6 = 1 AS is_vosb FROM customer""",
)
def f11(s, d):
    firms = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.expr(_TYPES).alias("business_types"))
    return notices.certifications(firms).drop("business_types")


_SINCE, _SCORER = "1999-08-01", "v2"
_VERSION = {day: ("v1" if day < "1999-09-01" else "v2") for day in _DAYS}


@registered(
    "a7_comparable_snapshots",
    "SELECT snapshot_date, count(*) AS n_ids, count(*) FILTER (place <= 50) AS n_top, CAST(sum(CASE WHEN place <= 50 THEN score10 END) AS BIGINT) AS top_score10, count(DISTINCT tier) AS n_tiers FROM (SELECT *, CASE WHEN tier <> 'Data Gap' AND days_left >= 0 THEN row_number() OVER (PARTITION BY snapshot_date, tier <> 'Data Gap' AND days_left >= 0 ORDER BY score10 DESC, candidate_id) END AS place FROM ("
    + " UNION ALL ".join(f"SELECT DATE '{x}' AS snapshot_date, candidate_id, tier, score10, days_left FROM ({_on(x)})" for x in _DAYS if x >= _SINCE and _VERSION[x] == _SCORER)
    + ")) GROUP BY 1",
)
def a7(s, d):
    """The archived dates that can be compared: not too old and scored by the same scorer."""
    path = _shared(s, "comparable")
    version = F.create_map(*[F.lit(x) for pair in _VERSION.items() for x in pair])[F.col("snapshot_date").cast("string")]
    _snapshots(s, d).withColumn("scorer_version", version).write.partitionBy("snapshot_date").parquet(path)
    scan = trust.comparable(s.read.parquet(path), _SINCE, _SCORER)
    return scan.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("n_ids"), F.count(F.when(F.col("place") <= 50, 1)).alias("n_top"), F.sum(F.when(F.col("place") <= 50, F.col("score10"))).alias("top_score10"), F.countDistinct("tier").alias("n_tiers")
    )
