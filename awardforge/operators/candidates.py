"""Classified awards to scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardforge.functions import rules
from awardforge.functions.rules import AS_OF, SPARK, Profile


def build(awards: DataFrame, mods: DataFrame | None = None, today: str = AS_OF, policy: str = "potential", least: int = rules.MIN_AWARD) -> DataFrame:
    """Candidates with expiry, window and bucket; a complete termination moves the expiry to its date and the row stays.

    ``mods`` (one row an award) may be missing, and so may an award's row in it: both leave honest defaults. Awards may
    have their signals with them instead, as a struct ``mods`` (:func:`history.histories`), and then nothing is joined.
    """
    chosen, basis = rules.expiry(policy)
    c = awards.where(F.col("cyber_it_flag") & (F.col("value") >= least)).withColumn("candidate_id", F.concat(F.lit("RC-"), "award_id")).withColumnRenamed("description", "title")
    c = c.withColumns({"expiry": F.expr(chosen), "expiry_basis": F.expr(basis)})
    within = "mods" in c.columns
    if mods is not None:
        c = c.join(mods.withColumnRenamed("award_key", "award_id"), "award_id", "left")
    elif within:
        c = c.select("*", "mods.*").drop("mods")
    if mods is not None or within:
        moved = F.coalesce((F.col("termination_kind") == "complete_likely") & F.col("termination_date").isNotNull(), F.lit(False))
        c = c.withColumn("expiry_basis", F.when(moved, "terminated").otherwise(F.col("expiry_basis"))).withColumn("expiry", F.when(moved, F.col("termination_date")).otherwise(F.col("expiry")))
        for name in ("terminated", "ceiling_balloon", "has_deobligation", "bridge_flag"):
            c = c.withColumn(name, F.coalesce(name, F.lit(False)))
        for name, value in (("termination_kind", "none"), ("termination_basis", "none"), ("bridge_basis", "insufficient"), ("mods_basis", "insufficient"), ("velocity_band", "n/a"), ("ceiling_basis", "insufficient")):
            c = c.withColumn(name, F.coalesce(name, F.lit(value)))
    c = runway(c, today)
    wide = F.col("value") >= 10_000_000
    return c.withColumns({"window_start": F.date_sub("expiry", F.when(wide, 548).otherwise(270)), "window_end": F.date_sub("expiry", F.when(wide, 180).otherwise(60))})


def runway(c: DataFrame, today: str = AS_OF) -> DataFrame:
    """Days left, status, bucket and phase at any date."""
    c = c.withColumn("days_left", F.expr(SPARK.days("expiry", today)))
    return c.withColumns({"status": F.expr(rules.status()), "bucket": F.expr(rules.bucket()), "phase": F.expr(rules.phase())})


def scored(c: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Components, score and tier for one firm."""
    c = c.withColumns({k: F.expr(v).cast("long") for k, v in rules.score_parts(SPARK, profile).items()})
    c = c.withColumn("score10", F.expr(rules.total_score(SPARK)).cast("long"))
    # as a generated column the tier is worked out once a row; a filter on a plain one is pushed down as a copy of the whole score for each mention
    tier = F.inline(F.array(F.struct(F.expr(rules.tier(SPARK)).alias("tier"))))
    return c.select("*", tier).withColumn("score", F.col("score10") / F.lit(10.0))


def default_view(s: DataFrame) -> DataFrame:
    """Forward-dated, confident and not quarantined."""
    return s.where("days_left >= 0 and confidence in ('Medium', 'High') and tier <> 'Data Gap'")


def breakdown(s: DataFrame) -> DataFrame:
    """One row for each candidate and component, with its weight."""
    parts = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(w).alias("weight"), F.col(c).alias("raw10")) for c, w in rules.WEIGHTS.items()])
    return s.select("candidate_id", F.explode(parts).alias("p")).select("candidate_id", F.col("p.component").alias("component"), F.col("p.weight").cast("long").alias("weight_pct"), "p.raw10", (F.col("p.weight") * F.col("p.raw10")).cast("long").alias("weighted1000"))


def rescored(c: DataFrame, profiles: list[Profile]) -> DataFrame:
    """Every candidate for each profile: the profiles are a handful of literals, so no join is made."""
    out = None
    for p in profiles:
        one = scored(c, p).select(F.lit(p.name).alias("profile"), "candidate_id", "score10", "tier")
        out = one if out is None else out.unionByName(one)
    return out
