"""Measured trust: label precision with intervals, abstention, stability, snapshots, alerts, samples, profiles, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson score interval of k of n; NULL for n = 0."""
    p, z2 = k / n, Z * Z
    centre, half = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    below = 1 + z2 / n
    return F.when(n > 0, (centre - half) / below), F.when(n > 0, (centre + half) / below)


def link_precision(labels: DataFrame, least: int = 30) -> DataFrame:
    """Correct share by tier; unsure labels stand apart; under ``least`` judged rows there is a gate state, not a number."""
    g = labels.groupBy("link_confidence").agg(
        F.count(F.when(F.col("label") == "correct", 1)).alias("k"), F.count(F.when(F.col("label").isin("correct", "incorrect"), 1)).alias("n"), F.count(F.when(F.col("label") == "unsure", 1)).alias("unsure"), F.countDistinct("label").alias("kinds")
    )
    state = F.when(F.col("n") < least, "below_floor").when(F.col("kinds") == 1, "bulk_fill").otherwise("measured")
    lo, hi = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    shown = lambda c: F.when(state == "measured", c)
    return g.select("link_confidence", "n", "unsure", state.alias("gate_state"), shown(F.col("k") / F.col("n")).alias("precision"), shown(lo).alias("ci_low"), shown(hi).alias("ci_high"))


def abstention(c: DataFrame, bases: dict[str, str]) -> DataFrame:
    """For each basis column: the share of candidates whose estimate was refused, in tenths of a percent."""
    rows = c.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(b) == refused, 1)).alias(b) for b, refused in bases.items()])
    long = rows.unpivot("n", list(bases), "metric", "refused")
    return long.select("metric", "n", "refused", F.when(F.col("n") > 0, F.expr("(refused * 2000 + n) div (2 * n)")).alias("refused_permille"))


def top_k(s: DataFrame, k: int, *order: Column) -> DataFrame:
    return s.orderBy(*order, "candidate_id").limit(k)


def naive_against_scored(s: DataFrame, k: int = 50) -> DataFrame:
    """Overlap of the k largest with the k best scored, and how many of each are quarantined."""
    open_rows = s.where("days_left >= 0")
    a, b = top_k(open_rows, k, F.col("value").desc()).select("candidate_id"), top_k(open_rows.where("tier <> 'Data Gap'"), k, F.col("score10").desc()).select("candidate_id")
    gap = s.where("tier = 'Data Gap'").select("candidate_id")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(a, "n_naive").crossJoin(one(b, "n_scored")).crossJoin(one(a.intersect(b), "n_both")).crossJoin(one(a.join(gap, "candidate_id", "left_semi"), "naive_quarantined"))


def rank_stability(snapshots: DataFrame, k: int = 50) -> DataFrame:
    """For each date and the one before: top-k overlap and how many tiers moved."""
    place = F.row_number().over(W.partitionBy("snapshot_date").orderBy(F.col("score10").desc(), "candidate_id"))
    days = snapshots.select("snapshot_date").distinct().withColumn("before", F.lag("snapshot_date").over(W.orderBy("snapshot_date"))).where("before is not null")
    x = snapshots.withColumn("place", place).select("snapshot_date", "candidate_id", "tier", "place")
    now = x.join(F.broadcast(days), "snapshot_date")
    old = x.select(F.col("snapshot_date").alias("before"), "candidate_id", F.col("tier").alias("old_tier"), F.col("place").alias("old_place"))
    both = now.join(old, ["before", "candidate_id"])
    return both.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n_shared"), F.count(F.when((F.col("place") <= k) & (F.col("old_place") <= k), 1)).alias("top_overlap"), F.count(F.when(F.col("tier") != F.col("old_tier"), 1)).alias("n_moved"))


def lead_time(snapshots: DataFrame, links: DataFrame, notices: DataFrame) -> DataFrame:
    """Days from the first snapshot that showed a candidate to its earliest notice."""
    first = snapshots.groupBy("candidate_id").agg(F.min("snapshot_date").alias("first_seen"))
    posted = links.where("link_confidence in ('High', 'Medium')").join(notices.select("notice_id", "posted_date"), "notice_id").where("posted_date is not null").groupBy("candidate_id").agg(F.min("posted_date").alias("posted"))
    return first.join(posted, "candidate_id").select("candidate_id", "first_seen", "posted", F.datediff("posted", "first_seen").alias("lead_days"))


def comparable(snapshots: DataFrame, since: str, scorer: str) -> DataFrame:
    """Snapshots from ``since`` on by the given scorer; ``place`` ranks the forward-dated rows outside quarantine (NULL for the rest)."""
    x = snapshots.where((F.col("snapshot_date") >= F.lit(since).cast("date")) & (F.col("scorer_version") == scorer))
    open_row = (F.col("tier") != "Data Gap") & F.coalesce(F.col("days_left") >= 0, F.lit(False))
    place = F.row_number().over(W.partitionBy("snapshot_date", open_row).orderBy(F.col("score10").desc(), "candidate_id"))
    return x.withColumn("place", F.when(open_row, place))


def diff(old: DataFrame, new: DataFrame, old_links: DataFrame, new_links: DataFrame) -> DataFrame:
    """What changed between two snapshots: new candidates, changed tiers, new notice links."""
    fresh = new.join(old, "candidate_id", "left_anti").select(F.lit("New candidate").alias("rule"), "candidate_id", F.col("tier").alias("detail"))
    moved = new.select("candidate_id", "tier").join(old.select("candidate_id", F.col("tier").alias("was")), "candidate_id").where("tier <> was").select(F.lit("Tier change").alias("rule"), "candidate_id", F.concat_ws(" > ", "was", "tier").alias("detail"))
    ids = lambda x, n: x.where("notice_id is not null").groupBy("candidate_id").agg(F.array_sort(F.collect_set("notice_id")).alias(n))
    linked = ids(new_links, "now").join(ids(old_links, "before"), "candidate_id", "left").select("candidate_id", F.explode(F.array_except("now", F.coalesce("before", F.array().cast("array<string>")))).alias("detail"))
    return fresh.unionByName(moved).unionByName(linked.select(F.lit("New notice link").alias("rule"), "candidate_id", "detail"))


#: Which rules each alert mode lets through.
ALERT_MODES = {"all": ("New candidate", "Tier change", "New notice link"), "action_needed": ("Tier change", "New notice link"), "new_only": ("New candidate",)}


def alerts(changes: DataFrame) -> DataFrame:
    """Each change under every mode that shows it."""
    modes = F.array(*[F.when(F.col("rule").isin(*rules), F.lit(mode)) for mode, rules in ALERT_MODES.items()])
    return changes.withColumn("mode", F.explode(F.array_compact(modes)))


def label_sample(s: DataFrame, size: int, seed: int = 7, top: int = 50, most_components: int = 5) -> DataFrame:
    """A stratified draw and the best scored, each case once: ``candidate_id, band, office, kind, sample_set``.

    Strata are value band, component (the largest ones by count, else OTHER) and kind of vehicle. Each stratum gives
    one case; the others are allotted in proportion to what is left of the strata, by largest remainder, so the quotas add up to
    ``size`` (to all rows where there are fewer). Cases are drawn in the order of a seeded hash. The ``top`` best are added, and those drawn already are ``both``.
    """
    band = F.when(F.col("value") >= 10_000_000, ">=$10M").when(F.col("value") >= 1_000_000, "$1M-$10M").otherwise("<$1M")
    kind = F.when(F.trim(F.coalesce("parent_idv", F.lit(""))) == "", "standalone").otherwise("vehicle")
    large = s.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(most_components).select("component", F.lit(True).alias("large"))
    x = s.select("candidate_id", "component", "score10", band.alias("band"), kind.alias("kind")).join(large, "component", "left")
    x = x.withColumn("office", F.when(F.col("large"), F.col("component")).otherwise("OTHER"))
    cell = ["band", "office", "kind"]
    # a few dozen strata: windows over all of them are small
    every = W.partitionBy(F.lit(1))
    n = x.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).withColumns({"cells": F.count(F.lit(1)).over(every), "all": F.sum("n").over(every)})
    n = n.withColumns({"share": F.expr(f"(n - 1) * greatest(least({size}, all) - cells, 0)"), "rest": F.expr("all - cells")})
    n = n.withColumns({"base": F.expr("case when rest > 0 then share div rest else 0 end"), "over": F.expr("case when rest > 0 then share % rest else 0 end")})
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("over"), *cell))
    extra = F.greatest(F.least(F.lit(size), F.col("all")) - F.col("cells"), F.lit(0)) - F.sum("base").over(every)
    quota = n.withColumn("quota", 1 + F.col("base") + (place <= extra).cast("int")).select(*cell, "quota")
    drawn = F.row_number().over(W.partitionBy(*cell).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "candidate_id")), "candidate_id"))
    drawn = x.withColumn("place", drawn).join(quota, cell).where("place <= quota").select("candidate_id", F.lit(True).alias("in_draw"))
    best = x.orderBy(F.desc("score10"), "candidate_id").limit(top).select("candidate_id", F.lit(True).alias("in_top"))
    both = drawn.join(best, "candidate_id", "full")
    name = F.when(F.col("in_draw") & F.col("in_top"), "both").when(F.col("in_top"), "top50").otherwise("stratified")
    return x.join(both, "candidate_id").select("candidate_id", *cell, name.alias("sample_set"))


def profiles(awards: DataFrame, k: int = 3) -> DataFrame:
    """For every firm: its top codes (count, dollars, code), components by frequency and the 90th percentile of positive values."""
    a = awards.where("uei is not null")

    def top(code: str) -> DataFrame:
        g = a.where(F.col(code).isNotNull()).groupBy("uei", code).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
        place = F.row_number().over(W.partitionBy("uei").orderBy(F.col("n").desc(), F.col("v").desc(), code))
        return g.withColumn("place", place).where(F.col("place") <= k).groupBy("uei").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", code))), lambda x: x[code]), ",").alias(f"top_{code}"))

    size = a.groupBy("uei").agg(F.count(F.lit(1)).alias("n_awards"), F.expr("percentile(case when value > 0 then cast(value as double) end, 0.9)").alias("p90"))
    return size.join(top("naics"), "uei", "left").join(top("psc"), "uei", "left").join(top("component"), "uei", "left")


def checks(s: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One pass over a table: for each named condition, how many rows break it (a NULL breaks it too)."""
    one = s.agg(*[F.count(F.when(~F.coalesce(F.expr(cond), F.lit(False)), 1)).alias(name) for name, cond in rules.items()])
    return one.unpivot([], list(rules), "check_name", "failing").select("check_name", (F.col("failing") == 0).alias("ok"), "failing")


def parity(name: str, derived: DataFrame, again: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``(check_name, ok, failing)``: rows of two derivations that are missing on one side or differ in a column; NULL equals NULL."""
    other = again.select(*[F.col(c).alias(f"_{c}") for c in (*key, *columns)], F.lit(True).alias("_there"))
    on = [derived[c].eqNullSafe(other[f"_{c}"]) for c in key]
    both = derived.select(*key, *columns, F.lit(True).alias("_here")).join(other, on, "full")
    same = F.col("_here").isNotNull() & F.col("_there").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    failing = F.count(F.when(~same, 1))
    return both.agg(F.lit(name).alias("check_name"), (failing == 0).alias("ok"), failing.alias("failing"))


def unique(name: str, df: DataFrame, key: str) -> DataFrame:
    """How many values of a key stand in more than one row, or are missing."""
    wrong = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    n = F.count(F.lit(1))
    return wrong.agg(F.lit(name).alias("check_name"), (n == 0).alias("ok"), n.alias("failing"))


def rescore(breakdown: DataFrame, quarantined: DataFrame) -> DataFrame:
    """``(candidate_id, score10, tier)`` anew from the long breakdown and the quarantine alone."""
    x = breakdown.groupBy("candidate_id").agg(F.expr("(sum(weighted1000) + 50) div 100").alias("score10"))
    x = x.join(quarantined.select("candidate_id", F.lit(True).alias("gap")), "candidate_id", "left")
    s = F.col("score10")
    tier = F.when(F.col("gap"), "Data Gap").when(s >= 800, "Tier 1: Pursue Now").when(s >= 650, "Tier 2: Capture Research").when(s >= 500, "Tier 3: Monitor").otherwise("Tier 4: Low Priority")
    return x.select("candidate_id", "score10", tier.alias("tier"))


def shares_again(reportable: DataFrame, least: int = 3) -> DataFrame:
    """``(component, top_share)`` from windows over vendors instead of two aggregations."""
    firms = reportable.where("trim(component) <> ''").groupBy("component", F.when(F.trim("uei") != "", F.trim("uei")).alias("uei")).agg(F.sum(F.coalesce("value", F.lit(0))).alias("net"))
    w = W.partitionBy("component")
    named = F.col("uei").isNotNull() & (F.col("net") > 0)
    x = firms.withColumns({"market": F.sum("net").over(w), "k": F.count(F.when(named, 1)).over(w), "known": F.sum(F.when(named, F.col("net"))).over(w), "place": F.row_number().over(w.orderBy(F.when(named, F.col("net")).desc_nulls_last()))})
    told = (F.col("k") >= least) & (F.col("market") > 0) & (F.col("known") * 100 >= F.col("market") * 85)
    return x.where("place = 1").select("component", F.when(told, F.expr("cast((net * 20000 + known) div (known * 2) as long)")).alias("top_share"))


def book_again(scored: DataFrame) -> DataFrame:
    """``(n, n_gap, value)``: the headline numbers from tier groups."""
    by = scored.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return by.agg(F.lit(1).alias("one"), F.sum("n").alias("n"), F.sum(F.when(F.col("tier") == "Data Gap", F.col("n")).otherwise(0)).alias("n_gap"), F.sum("value").alias("value"))
