"""Opportunity notices from bulk CSV files and from nested JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from awardforge.functions import rules

# The headers of the bulk export and the names used here.
NOTICE_COLUMNS = {
    "NoticeId": "notice_id", "Sol#": "solicitation_number", "Title": "title", "Type": "notice_type", "PostedDate": "posted_date", "ResponseDeadLine": "response_deadline", "ArchiveDate": "archive_date",
    "Department/Ind.Agency": "agency", "Sub-Tier": "subagency", "Office": "office", "NaicsCode": "naics", "ClassificationCode": "psc", "SetASide": "set_aside", "SetASideCode": "set_aside_code",
    "PopState": "place_of_performance_state", "Link": "source_url",
}
NOTICE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in NOTICE_COLUMNS])
LIVE_SCHEMA = (
    "noticeId string, type string, solicitationNumber string, title string, naicsCode string, naics string, fullParentPathName string, department string, "
    "placeOfPerformance struct<state:string>, postedDate string, notice_id string, notice_type string, solicitation_number string, agency string, place_of_performance_state string, posted_date string"
)


def iso_day(x: Column) -> Column:
    """The calendar date at the head of any ISO time, as text; anything else is an empty text."""
    head = F.substring(F.trim(F.coalesce(x, F.lit(""))), 1, 10)
    return F.when(head.rlike("^.{4}-.{2}-.{2}$"), head).otherwise("")


def scan_notices(spark: SparkSession, paths: str | list[str], naics: tuple[str, ...] = rules.NAICS_SCOPE, department: str | None = "DEFENSE") -> DataFrame:
    """Bulk notice files: sixteen renamed columns, NULL as an empty text, codes in scope, departments that hold ``department``."""
    raw = spark.read.schema(NOTICE_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(paths)
    kept = raw.where(F.trim("NaicsCode").isin(*naics))
    if department:
        kept = kept.where(F.upper(F.coalesce(F.col("`Department/Ind.Agency`"), F.lit(""))).contains(department))
    tidy = {name: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c, name in NOTICE_COLUMNS.items()}
    return kept.select(*[(iso_day(v) if k in ("posted_date", "response_deadline", "archive_date") else v).alias(k) for k, v in tidy.items()])


def from_json_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Live or already normalised JSON records to the eight columns that linking reads.

    A record with a ``notice_id`` is normalised already. A live one has its code as a scalar or as a list
    (the first entry counts), its agency as the first segment of a dotted path, and its state as a code, a name or a text.
    """
    r = records.select(F.from_json(column, LIVE_SCHEMA).alias("r"), F.col(column).alias("_text"))
    full = lambda x: F.nullif(F.trim(x), F.lit(""))
    first = F.when(F.col("r.naics").startswith("["), F.get(F.from_json("r.naics", "array<string>"), 0)).otherwise(None)
    listed = F.when(first.startswith("{"), F.coalesce(full(F.get_json_object(first, "$.code")), full(F.get_json_object(first, "$.naicsCode")))).otherwise(first)
    state = F.col("r.placeOfPerformance.state")
    place = F.when(state.startswith("{"), F.coalesce(full(F.get_json_object(state, "$.code")), full(F.get_json_object(state, "$.name")))).otherwise(full(state))
    live = F.struct(
        F.col("r.noticeId").alias("notice_id"), F.col("r.type").alias("notice_type"), F.col("r.solicitationNumber").alias("solicitation_number"), F.col("r.title").alias("title"),
        F.coalesce(full(F.col("r.naicsCode")), listed).alias("naics"),
        F.coalesce(F.upper(full(F.substring_index("r.fullParentPathName", ".", 1))), F.upper(full(F.col("r.department"))), F.lit("UNKNOWN")).alias("agency"),
        F.upper(F.trim(place)).alias("place_of_performance_state"), F.col("r.postedDate").alias("posted_date"),
    )
    plain = F.struct(
        F.col("r.notice_id").alias("notice_id"), F.col("r.notice_type").alias("notice_type"), F.col("r.solicitation_number").alias("solicitation_number"), F.col("r.title").alias("title"),
        full(F.col("r.naics")).alias("naics"), F.coalesce(F.upper(full(F.col("r.agency"))), F.lit("UNKNOWN")).alias("agency"),
        F.upper(full(F.col("r.place_of_performance_state"))).alias("place_of_performance_state"), F.col("r.posted_date").alias("posted_date"),
    )
    return r.select(F.when(F.col("r.notice_id").isNotNull(), plain).otherwise(live).alias("n")).select("n.*")


CERTS_SCHEMA = "struct<sbaBusinessTypeList:array<struct<sbaBusinessTypeDesc:string,certificationExitDate:string>>,businessTypeList:array<struct<businessTypeDesc:string>>>"


def certifications(entities: DataFrame, column: str = "business_types") -> DataFrame:
    """``entities`` with the flags that its nested lists of business types tell; a joint venture is another firm and does not count."""
    c = F.from_json(column, CERTS_SCHEMA)
    none = F.array().cast("array<struct<text:string,ends:date>>")
    sba = F.transform(c["sbaBusinessTypeList"], lambda x: F.struct(F.lower(F.coalesce(x["sbaBusinessTypeDesc"], F.lit(""))).alias("text"), F.substring(x["certificationExitDate"], 1, 10).try_cast("date").alias("ends")))
    own = F.transform(c["businessTypeList"], lambda x: F.struct(F.lower(F.coalesce(x["businessTypeDesc"], F.lit(""))).alias("text"), F.lit(None).cast("date").alias("ends")))
    entries = F.filter(F.concat(F.coalesce(sba, none), F.coalesce(own, none)), lambda e: ~e["text"].contains("joint venture"))
    e = entities.withColumn("_e", entries)
    has = lambda *words: F.exists("_e", lambda x: _any(x["text"], words))
    disabled = ("service-disabled veteran", "service disabled veteran")
    ends = F.filter("_e", lambda x: x["text"].contains("8(a)") & x["ends"].isNotNull())
    return e.withColumns(
        {
            "is_8a": has("8(a)"),
            "program_exit_date_8a": F.get(F.reverse(ends), 0)["ends"],
            "is_hubzone": has("hubzone"),
            "is_wosb": has("women"),
            "is_edwosb": F.exists("_e", lambda x: x["text"].contains("women") & x["text"].contains("economically disadvantaged")),
            "is_sdvosb": has(*disabled),
            "is_vosb": F.exists("_e", lambda x: _any(x["text"], ("veteran-owned", "veteran owned")) & ~_any(x["text"], disabled)),
        }
    ).drop("_e")


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out
