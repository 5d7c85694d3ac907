"""Reading and writing: transaction CSV, notices, star schema, snapshots, formula-safe and JSON exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from awardforge.functions import rules

TRANSACTION_COLUMNS = [
    "contract_transaction_unique_key", "contract_award_unique_key", "award_id_piid", "modification_number", "action_date", "action_type_code", "correction_delete_ind", "federal_action_obligation",
    "period_of_performance_potential_end_date", "recipient_name", "recipient_uei", "naics_code", "product_or_service_code", "transaction_description",
]
TRANSACTION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TRANSACTION_COLUMNS])

#: Spark's setting by which the shuffle files of a command go at its end.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(s: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share."""
    folder = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    if not folder:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        s.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/awardforge/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """A table that is read several times, written once. What was shuffled for it goes when it is written, so that shuffles of one table after the other do not add up on the disk."""
    s, path = df.sparkSession, scratch(df.sparkSession, tag)
    before = s.conf.get(CLEANED)
    s.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        s.conf.set(CLEANED, before)
    return s.read.parquet(path)


def dollars(x: Column) -> Column:
    """``$1,234.50`` as a decimal; blank or marks only is NULL."""
    return F.regexp_replace(x, "[^0-9.-]", "").try_cast("decimal(18,2)")


def day(x: Column) -> Column:
    """``YYYY-MM-DD`` with or without a time; anything else is NULL."""
    d = F.substring(F.trim(x), 1, 10)
    return F.when(F.trim(x).rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$"), d.try_cast("date"))


def code(x: Column) -> Column:
    """A code without the ``.0`` that a spreadsheet adds."""
    return F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"\.0$", "")


def scan_transactions(spark: SparkSession, paths: str | list[str], naics: tuple[str, ...] = rules.NAICS_SCOPE) -> DataFrame:
    """Bulk CSV files with quoted cells of any length; rows out of scope go; the award key falls back to the contract number."""
    raw = spark.read.schema(TRANSACTION_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(paths)
    key = F.nullif(F.trim("contract_award_unique_key"), F.lit(""))
    return raw.where(code(F.col("naics_code")).isin(*naics)).select(
        F.coalesce(key, F.trim("award_id_piid")).alias("award_key"), key.isNull().alias("fallback_key"), F.nullif(F.trim("contract_transaction_unique_key"), F.lit("")).alias("txn_key"), F.col("modification_number").alias("mod_no"),
        day(F.col("action_date")).alias("action_date"), F.col("action_type_code"), F.col("correction_delete_ind").alias("delete_ind"), dollars(F.col("federal_action_obligation")).alias("obligation"),
        day(F.col("period_of_performance_potential_end_date")).alias("potential_end"), "recipient_name", "recipient_uei", code(F.col("naics_code")).alias("naics"), code(F.col("product_or_service_code")).alias("psc"), F.col("transaction_description").alias("description"),
        F.col("_metadata.file_path").alias("file_path"),
    )


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"(?<!\d)(?:\+?1[-. ])?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}(?!\d)"


def scrub(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, EMAIL, "[EMAIL REDACTED]"), PHONE, "[PHONE REDACTED]")


def formula_safe(df: DataFrame) -> DataFrame:
    """Strings that a spreadsheet would run get a quote in front."""
    safe = lambda c: F.when(F.col(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c))
    return df.select(*[safe(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def fact_claims(c: DataFrame) -> DataFrame:
    """One JSON text for each candidate with a contract number, nulls explicit; no score, tier or raw title."""
    keep = ["candidate_id", "piid", "vendor", "component", "naics", "psc", "award_type", "set_aside_code", "expiry", "expiry_basis", "state"]
    short = lambda k: F.when(F.length(F.col(k).cast("string")) <= 500, F.col(k)).alias(k)
    return c.where("trim(piid) <> ''").select("candidate_id", F.to_json(F.struct(*[short(k) for k in keep]), {"ignoreNullFields": "false"}).alias("claims"))


def write_star(tables: dict[str, DataFrame], path: str, free_text: dict[str, tuple[str, ...]], csv: tuple[str, ...] = ()) -> None:
    """Each table as Parquet, and those in ``csv`` as CSV beside it; free text is scrubbed on the way."""
    for name, df in tables.items():
        clean = df.select(*[scrub(F.col(c)).alias(c) if c in free_text.get(name, ()) else F.col(c) for c in df.columns])
        clean.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        if name in csv:
            clean.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}.csv")


def read_star(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every table of a folder as a view of its name: a Parquet table goes before a CSV of the same name. The folder may be in any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = [f.getPath().getName() for f in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)]
    found = {}
    for file in sorted(there, key=lambda f: (not f.endswith(".parquet"), f)):
        name, _, kind = file.rpartition(".")
        if kind in ("parquet", "csv") and name not in found:
            found[name] = spark.read.parquet(f"{path}/{file}") if kind == "parquet" else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/{file}")
            found[name].createOrReplaceTempView(name)
    return found


def archive(df: DataFrame, path: str, date: str) -> None:
    """Replace one date of a snapshot table and leave the others."""
    df.withColumn("snapshot_date", F.lit(date).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and an order-free hash of each table."""
    out = None
    for name, df in tables.items():
        one = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("content"))
        out = one if out is None else out.unionByName(one)
    return out


def newest_reference(vintages: DataFrame, curated: DataFrame) -> DataFrame:
    """Codes of all vintages, the newest description of each; curated flags stay; curated-only rows are kept."""
    w = W.partitionBy("code").orderBy(F.col("vintage").desc(), "description")
    v = vintages.withColumn("code", F.upper(F.trim("code"))).where("trim(description) <> ''").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    c = curated.select(F.upper("code").alias("code"), F.col("description").alias("own"), "relevant")
    known = v.join(F.broadcast(c), "code", "left").select("code", "description", F.coalesce("relevant", F.lit(False)).alias("relevant"))
    only = c.join(v, "code", "left_anti").select("code", F.col("own").alias("description"), "relevant")
    return known.unionByName(only)
