"""Signals and gates on candidates: pace, successor, displacement, size shift, concentration, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from awardforge.functions import rules
from awardforge.functions.rules import AS_OF, SPARK

CELL = ["naics", "psc2", "component"]


def pace(c: DataFrame, today: str = AS_OF) -> DataFrame:
    for name, rule in rules.pace(SPARK, today).items():
        c = c.withColumn(name, F.expr(rule))
    return c


def successors(c: DataFrame, awards: DataFrame, least: int = 3) -> DataFrame:
    """Whether a later award in the same cell is visible that is neither the award itself nor under its own parent.

    A cell is reduced first: for each (cell, parent) the two latest awards, then only the three best parents
    of the cell can answer any candidate, because it rules out one parent and one award at most.
    """
    pool = awards.withColumn("psc2", F.substring(F.trim("psc"), 1, 2)).where("trim(naics) <> '' and psc2 <> '' and trim(component) <> ''")
    sizes = pool.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_cell"))
    own_parent = F.coalesce(F.trim("parent_idv"), F.lit(""))
    newest = F.row_number().over(W.partitionBy(*CELL, "parent").orderBy(F.col("signed").desc(), F.col("award_id").desc()))
    # Spark keeps two rows a parent before the shuffle already
    dated = pool.where("signed is not null").select(*CELL, own_parent.alias("parent"), "signed", "award_id")
    listed = dated.withColumn("n", newest).where("n <= 2").drop("n")
    place = F.dense_rank().over(W.partitionBy(*CELL).orderBy(F.col("best").desc(), "parent"))
    best = listed.withColumn("best", F.max(F.struct("signed", "award_id")).over(W.partitionBy(*CELL, "parent"))).withColumn("place", place).where("place <= 3 or parent = ''")
    short = best.groupBy(*CELL).agg(F.collect_list(F.struct("parent", "signed", "award_id")).alias("latest"))
    x = c.withColumn("psc2", F.substring(F.trim("psc"), 1, 2)).join(sizes, CELL, "left").join(short, CELL, "left")
    own = F.coalesce(F.trim("parent_idv"), F.lit(""))
    seen = F.exists("latest", lambda a: (a["signed"] > F.col("expiry")) & (a["award_id"] != F.col("award_id")) & ((own == "") | (a["parent"] != own)))
    basis = F.when((F.coalesce("n_cell", F.lit(0)) < least) | F.col("expiry").isNull(), "insufficient_cell").when(F.coalesce(seen, F.lit(False)), "observed").otherwise("none_visible")
    out = x.withColumn("successor_basis", basis).drop("latest", "n_cell", "psc2")
    return out.withColumn("successor_visible", F.when(F.col("successor_basis") != "insufficient_cell", F.col("successor_basis") == "observed"))


def size_shift(awards: DataFrame, least: int = 3) -> DataFrame:
    """Firms that were small in a NAICS and whose latest dated award there is other than small."""
    read = awards.where("uei is not null and upper(trim(size_code)) in ('S', 'O')").withColumn("code", F.upper(F.trim("size_code")))
    cell = read.groupBy("uei", "naics").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("code", F.when(F.col("signed").isNotNull(), F.struct("signed", "award_id"))).alias("last_code"),
        F.max("signed").alias("last_date"),
        F.min(F.when(F.col("code") == "S", F.col("signed"))).alias("first_small"),
    )
    shifted = (F.col("n") >= least) & (F.col("last_code") == "O") & (F.col("first_small") < F.col("last_date"))
    out = cell.groupBy("uei").agg(F.max(F.when(F.col("n") >= least, 1).otherwise(0)).alias("readable"), F.min(F.when(shifted, F.col("naics"))).alias("shift_naics"))
    return out.select("uei", F.when(F.col("readable") == 1, F.col("shift_naics").isNotNull()).alias("size_shift"), "shift_naics", F.when(F.col("readable") == 1, "observed").otherwise("insufficient").alias("size_basis"))


SIGNALS = ("bridge", "termination", "deobligation", "lapsed_no_successor", "sole_offer", "size_shift")


def displacement(c: DataFrame, shifts: DataFrame, least: int = 3) -> DataFrame:
    """Six three-state signals (fired, quiet, unknown) and what they add up to."""
    state = lambda cond, quiet: F.when(cond, 1).when(quiet, 0)
    offers, competed = F.col("offers"), F.upper(F.trim("extent_code")).isin("A", "D", "F")
    plausible = ~offers.isin(117, 253) & offers.between(1, 100)
    reads = {
        "bridge": F.when(F.col("bridge_basis") == "observed", F.col("bridge_flag").cast("int")),
        "termination": state(F.col("terminated"), F.col("termination_basis") == "none"),
        "deobligation": F.col("has_deobligation").cast("int"),
        "lapsed_no_successor": F.when(F.col("status") == "active", 0).when(F.col("successor_basis") == "none_visible", 1).when(F.col("successor_basis") == "observed", 0),
        "sole_offer": F.when(plausible & (offers > 1), 0).when(plausible & competed, 1),
        "size_shift": F.col("size_shift").cast("int"),
    }
    x = c.join(shifts.select("uei", "size_shift"), "uei", "left")
    # a stale row is not read at all
    x = x.withColumns({f"_{k}": F.when(F.col("status") != "expired_stale", v) for k, v in reads.items()})
    every = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"_{k}").alias("s")) for k in SIGNALS])
    names = lambda keep: F.array_join(F.transform(F.filter(every, keep), lambda e: e["name"]), "+")
    fired, unread = names(lambda e: e["s"] == 1), names(lambda e: e["s"].isNull())
    n_read = F.size(F.filter(every, lambda e: e["s"].isNotNull()))
    n_fired = F.size(F.filter(every, lambda e: e["s"] == 1))
    ok = n_read >= least
    none = lambda t: F.when(t == "", "none").otherwise(t)
    return x.withColumns(
        {
            "displacement_count": F.when(ok, n_fired.cast("long")),
            "displacement_read": n_read.cast("long"),
            "displacement_signals": F.when(ok, none(fired)),
            "displacement_unread": none(unread),
            "displacement_band": F.when(~ok, "n/a").when(n_fired >= 2, "multiple_signals").when(n_fired == 1, "single_signal").otherwise("none_observed"),
            "displacement_basis": F.when(ok, "observed").otherwise("insufficient"),
        }
    ).drop(*[f"_{k}" for k in SIGNALS])


def concentration(c: DataFrame, least: int = 3) -> DataFrame:
    """The top vendor's share of attributed dollars in each component, or the gate that refused."""
    by_firm = c.where("trim(component) <> ''").groupBy("component", F.nullif(F.trim("uei"), F.lit("")).alias("uei")).agg(F.sum(F.coalesce("value", F.lit(0))).alias("net"))
    m = by_firm.groupBy("component").agg(
        F.sum("net").alias("market"),
        F.count(F.when(F.col("uei").isNotNull() & (F.col("net") > 0), 1)).alias("n_firms"),
        F.coalesce(F.sum(F.when(F.col("uei").isNotNull() & (F.col("net") > 0), F.col("net"))), F.lit(0)).alias("attributed"),
        F.max(F.when(F.col("uei").isNotNull() & (F.col("net") > 0), F.col("net"))).alias("top"),
    )
    reason = F.when(F.col("n_firms") < least, "too few vendors").when(F.col("market") <= 0, "no positive dollars").when(F.col("attributed") * 100 < F.col("market") * 85, "unattributed dollars").otherwise("")
    share = F.when(reason == "", F.expr("cast((top * 20000 + attributed) div (attributed * 2) as long)"))
    return m.select("component", "n_firms", share.alias("top_share"), F.when(reason == "", "observed").otherwise("insufficient").alias("concentration_basis"), reason.alias("reason"))


def eligible(c: DataFrame, firms: dict[str, tuple[dict[str, bool], str | None]]) -> DataFrame:
    """Each firm's standing for each candidate's set-aside; firms are a handful of literals."""
    out = None
    for firm, (certs, exit_date) in firms.items():
        one = c.select(F.lit(firm).alias("firm"), "candidate_id", "set_aside_code", F.expr(rules.eligibility(certs, exit_date)).alias("eligible"))
        out = one if out is None else out.unionByName(one)
    return out


def prime_path(standing: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Whether each firm may lead: gate / warn / unknown / clear, the basis, and the code that decides.

    A live notice's code comes first and gates; the expiring contract's code only warns. A blank code is not the code NONE. ``standing`` has
    ``firm, candidate_id, set_aside_code, eligible`` and ``live`` ``firm, candidate_id, notice_code, notice_eligible``; ``eligible`` is NULL
    for a firm without certificates on file (nothing was checked).
    """
    if live is None:
        x = standing.withColumns({"notice_code": F.lit(None).cast("string"), "notice_eligible": F.lit(None).cast("boolean")})
    else:
        x = standing.join(live.select("firm", "candidate_id", "notice_code", "notice_eligible"), ["firm", "candidate_id"], "left")
    tidy = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    notice, code = tidy("notice_code"), tidy("set_aside_code")
    on_notice = ~notice.isin("", "NONE")
    checked = F.when(on_notice, F.col("notice_eligible")).otherwise(F.col("eligible"))
    restricted = on_notice | ~code.isin("", "NONE")
    state = (
        F.when(restricted & checked.isNull(), "unknown")
        .when(on_notice & ~checked, "gate")
        .when(on_notice, "clear")
        .when(code == "", "unknown")
        .when(code == "NONE", "clear")
        .when(~checked, "warn")
        .otherwise("clear")
    )
    basis = F.when(restricted & checked.isNull(), "no_profile").when(on_notice, "notice_confirmed").when(code == "", "not_reported").otherwise("historical_fpds")
    return x.select("firm", "candidate_id", state.alias("lane"), basis.alias("lane_basis"), F.when(on_notice, notice).otherwise(code).alias("source_code"), state.isin("gate", "warn").alias("teaming"))
