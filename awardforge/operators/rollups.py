"""Rollups, dimensions and report rows. Every sum is over decimals; a window without a partition runs only over grouped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from awardforge.functions import rules


def zero() -> Column:
    return F.lit(0).cast("decimal(28,2)")


def within(days: int) -> Column:
    """Value that expires in the next ``days`` days; what has expired is not expiring."""
    return F.coalesce(F.sum(F.when(F.col("days_left").between(0, days), F.col("value"))), zero())


def permille(part: Column, whole: Column) -> Column:
    """Whole tenths of a percent, halves up; NULL where the whole is nothing."""
    # a quotient of decimals is rounded to six places, which can reach the next whole number: whole division is exact
    return F.when(whole > 0, F.call_function("div", part * 2000 + whole, whole * 2))


def incumbents(c: DataFrame) -> DataFrame:
    """Per vendor: sums, forward value, share of the market, and vulnerability with its basis (coverage gate first)."""
    floor0 = lambda x: F.greatest(F.coalesce(x, zero()), zero())
    g = c.groupBy("vendor").agg(
        F.min("uei").alias("uei"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.sum("value").alias("total"),
        within(180).alias("value_6m"),
        within(365).alias("value_12m"),
        within(730).alias("value_24m"),
        F.sum(F.when(F.col("days_left").isNotNull(), F.col("value"))).alias("known"),
        F.sum(F.when(F.col("days_left") < 0, F.col("value"))).alias("expired"),
        F.sum(F.when(F.col("days_left") >= 0, F.col("value"))).alias("forward"),
    )
    market = g.agg(F.sum("total").alias("market"))
    basis = F.when(floor0(F.col("known")) * 2 < floor0(F.col("total")), "insufficient_coverage").when(floor0(F.col("forward")) <= 0, "no_forward_book").otherwise("scored")
    out = g.crossJoin(F.broadcast(market)).withColumn("basis", basis)
    return out.select(
        "vendor", "uei", "n_candidates", "total", "value_6m", "value_12m", "value_24m",
        permille(F.col("total"), F.col("market")).alias("share_permille"),
        F.when(F.col("basis") == "scored", F.least(F.lit(1000), permille(floor0(F.col("value_6m")), floor0(F.col("forward"))))).cast("long").alias("vulnerability10"),
        F.col("basis").alias("vulnerability_basis"),
        F.least(F.lit(1000), permille(floor0(F.col("expired")), floor0(F.col("total")))).cast("long").alias("expired_permille"),
    )


def agencies(c: DataFrame) -> DataFrame:
    n = lambda d: F.count(F.when(F.col("days_left").between(0, d), 1))
    return c.groupBy("agency", "component").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_contracts"), n(180).alias("n_6m"), n(365).alias("n_12m"), n(730).alias("n_24m"), within(730).alias("pipeline"))


def vehicles(c: DataFrame) -> DataFrame:
    """Orders under one parent contract."""
    order = F.when(F.col("tier") == "Data Gap", 9).otherwise(F.substring("tier", 6, 1).cast("int"))
    return c.where("parent_idv is not null").groupBy("parent_idv").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("value").alias("total"), F.min("expiry").alias("next_expiry"), F.min_by("tier", F.struct(order, "candidate_id")).alias("best_tier"), F.min_by("title", "award_id").alias("first_title")
    )


def kpis(s: DataFrame) -> DataFrame:
    """One row; each top name is the greatest sum, ties to the first name."""
    forward, soon = F.col("days_left") >= 0, F.col("days_left").between(0, 365)
    top = lambda name, cond: s.where(cond).groupBy(name).agg(F.sum("value").alias("v")).agg(F.min_by(name, F.struct(-F.col("v"), F.col(name))).alias(f"top_{name}"))
    row = s.agg(
        F.sum(F.when(forward, F.col("value"))).alias("pipeline"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.count(F.when(F.col("tier") == rules.TIERS[0][1], 1)).alias("n_tier1"),
        F.count(F.when(soon, 1)).alias("n_12m"),
        F.count(F.when(F.col("status") == "active", 1)).alias("n_active"),
        F.count(F.when(F.col("status") == "expired_grace", 1)).alias("n_grace"),
        F.count(F.when(F.col("status") == "expired_stale", 1)).alias("n_stale"),
        F.countDistinct("parent_idv").alias("n_vehicles"),
        F.expr("percentile(case when days_left >= 0 then days_left end, 0.5)").alias("median_runway"),
    )
    return row.crossJoin(top("component", forward)).crossJoin(top("vendor", soon))


def quality_report(awards: DataFrame, c: DataFrame) -> DataFrame:
    """metric, value, category rows."""
    one = awards.agg(F.count(F.lit(1)).alias("awards"), (F.count("piid") - F.countDistinct("piid")).alias("repeated_piid"), F.count(F.when(F.col("current_end").isNull() & F.col("potential_end").isNull(), 1)).alias("without_end"), F.count(F.when(F.col("uei").isNull(), 1)).alias("without_uei"))
    rows = one.unpivot([], ["awards", "repeated_piid", "without_end", "without_uei"], "metric", "value").withColumn("category", F.lit("awards"))
    levels = awards.groupBy(F.col("confidence").alias("metric")).agg(F.count(F.lit(1)).alias("value")).withColumn("category", F.lit("confidence"))
    age = F.when(F.col("days_left") >= -365, "under 1 year").when(F.col("days_left") >= -1095, "1 to 3 years").otherwise("over 3 years")
    stale = c.where("days_left < -90").groupBy(age.alias("metric")).agg(F.count(F.lit(1)).alias("value")).withColumn("category", F.lit("stale age"))
    return rows.unionByName(levels).unionByName(stale)


def date_dimension(c: DataFrame, today: str = rules.AS_OF) -> DataFrame:
    """Every day from the first date seen to two years past the last."""
    ends = c.agg(F.least(F.min("pop_start"), F.expr(today)).alias("a"), F.greatest(F.max("expiry"), F.expr(today)).alias("b"))
    days = ends.select(F.explode(F.sequence("a", F.date_add("b", 730))).alias("day"))
    f = rules.fiscal("day")
    return days.select("day", F.date_format("day", "yyyyMMdd").cast("int").alias("date_key"), *[F.expr(f[k]).alias(k) for k in f])


def surrogate_keys(dim: DataFrame, name: str, *order) -> DataFrame:
    """1..n in the dimension's order: dimensions are small, so one ordered pass over them is fine."""
    return dim.withColumn(f"{name}_key", F.row_number().over(W.orderBy(*order)))


def added_codes(facts: DataFrame, lookup: DataFrame, code: str) -> DataFrame:
    """The lookup with the codes that only the facts know."""
    new = facts.select(code).where(F.col(code).isNotNull()).distinct().join(lookup, code, "left_anti")
    return lookup.withColumn("origin", F.lit("lookup")).unionByName(new.withColumn("origin", F.lit("seen in facts")), allowMissingColumns=True)


def pareto(c: DataFrame, by: str = "vendor") -> DataFrame:
    """Cumulative share by value, largest first."""
    g = c.groupBy(by).agg(F.sum("value").alias("v"))
    w = W.orderBy(F.col("v").desc(), by)
    x = g.withColumn("place", F.row_number().over(w)).withColumn("upto", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)))
    total = g.agg(F.sum("v").alias("all"))
    return x.crossJoin(F.broadcast(total)).select(by, F.col("place").cast("long").alias("place"), "v", permille(F.col("upto"), F.col("all")).alias("cumulative_permille"))


def expiry_histogram(c: DataFrame, bins: int = 24) -> DataFrame:
    ends = c.agg(F.min("expiry").alias("a"), F.max("expiry").alias("b"))
    x = c.where("expiry is not null").crossJoin(F.broadcast(ends))
    width = F.datediff("b", "a")
    at = F.least(F.lit(bins - 1), F.when(width > 0, F.expr(f"(datediff(expiry, a) * {bins}) div datediff(b, a)")).otherwise(0))
    return x.groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("expiry").alias("first"), F.max("expiry").alias("last"))


def pivot_by_psc(c: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    return c.groupBy("component").pivot("psc", list(codes)).agg(F.sum("value")).na.fill(0)


def footprint(c: DataFrame) -> DataFrame:
    return c.groupBy("vendor").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), within(365).alias("value_12m"), F.count(F.when(F.col("days_left").between(0, 365), 1)).alias("n_12m"))


def board(s: DataFrame, n: int = 15) -> DataFrame:
    """The nearest expiries of the two best tiers."""
    return s.where("days_left >= 0 and tier like 'Tier 1%' or days_left >= 0 and tier like 'Tier 2%'").orderBy("days_left", "candidate_id").limit(n)


def other_contracts(c: DataFrame, n: int = 25) -> DataFrame:
    """For each vendor its largest contracts."""
    return c.withColumn("place", F.row_number().over(W.partitionBy("vendor").orderBy(F.col("value").desc(), "candidate_id"))).where(F.col("place") <= n)
