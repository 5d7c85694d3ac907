"""Transactions to awards: de-duplication, latest record, modification digest and its signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from awardforge.functions import rules

TIE = ["action_date", "l_partkey", "l_suppkey", "l_extendedprice"]
TERMINATIONS = ("E", "F", "X", "N")
BRIDGES = ("B", "C", "G")
GRACE_DAYS, BRIDGE_DAYS, NEGATIVE, DEOBLIGATION = 31, 30, -10_000, -100_000
#: A column that a table of transactions may have: a number that is one to one with the award's key, where a transaction's key is of one award. Rows that lie by it are not dealt again.
DEALT = "award_no"


def _dealt(txn: DataFrame) -> list[str]:
    return [DEALT] if DEALT in txn.columns else []


def _marked(txn: DataFrame) -> DataFrame:
    """Transactions that lie by award, with ``_kept``: whether the row counts. An award's rows without a key are few, so they need no way of their own."""
    first = F.row_number().over(W.partitionBy(DEALT, "txn_key").orderBy(*TIE))
    return txn.withColumn("_kept", ((first == 1) | (F.coalesce("txn_key", F.lit("")) == "")) & (F.coalesce("delete_ind", F.lit("")) != "D"))


def kept_transactions(txn: DataFrame) -> DataFrame:
    """Each transaction key once, the first by date; rows without a key all count; retracted rows (mark D) never."""
    if _dealt(txn):
        return _marked(txn).where("_kept").drop("_kept")
    first = F.row_number().over(W.partitionBy("txn_key").orderBy(*TIE))
    keyed = txn.where("txn_key is not null and txn_key <> ''").withColumn("_n", first).where("_n = 1").drop("_n")
    return keyed.unionByName(txn.where("txn_key is null or txn_key = ''")).where("coalesce(delete_ind, '') <> 'D'")


def _latest(value: Column) -> Column:
    return F.max_by(value, F.struct(F.col("action_date"), F.col("txn_key"), *[F.col(c) for c in TIE[1:]]))


def latest_records(txn: DataFrame) -> DataFrame:
    """The record of each award: its latest transaction by date and key. Retracted rows still compete."""
    row = F.struct(*[F.col(c) for c in txn.columns])
    return txn.where("award_key is not null").groupBy(*(_dealt(txn) or ["award_key"])).agg(_latest(row).alias("r")).select("r.*").drop(DEALT)


def _at(first: bool, value: Column, when: Column) -> Column:
    order = F.when(when, F.struct("action_date", "mod_no", "txn_key"))
    return (F.min_by if first else F.max_by)(value, order)


def folds(kept: Column | None = None) -> list[Column]:
    """What is kept of an award's transactions, as aggregates that take rows in any order, in a batch or a stream. ``kept``: which rows count, all of them if not given."""
    event = F.struct("action_date", "mod_no", "txn_key", "action_type_code", "obligation")
    kept = F.lit(True) if kept is None else kept
    ceiling, planned = kept & (F.col("ceiling_total") > 0), kept & F.col("potential_end").isNotNull()
    terminated = kept & F.col("action_type_code").isin(*TERMINATIONS)
    return [
        F.count(F.when(kept, 1)).alias("mod_count"),
        F.min(F.when(kept, F.col("action_date"))).alias("first_action"),
        F.max(F.when(kept, F.col("action_date"))).alias("last_action"),
        _at(True, F.col("ceiling_total"), ceiling).alias("first_ceiling"),
        _at(False, F.col("ceiling_total"), ceiling).alias("last_ceiling"),
        _at(True, F.col("txn_key"), ceiling).alias("first_ceiling_key"),
        _at(False, F.col("txn_key"), ceiling).alias("last_ceiling_key"),
        _at(True, F.col("potential_end"), planned).alias("first_planned_end"),
        _at(False, F.col("current_end"), kept & F.col("current_end").isNotNull()).alias("end_of_record"),
        F.max(F.when(kept & F.col("extent_code").isin(*BRIDGES), F.col("current_end"))).alias("bridge_end"),
        F.array_sort(F.collect_list(F.when(terminated, event))).alias("terminations"),
        F.array_sort(F.collect_list(F.when(kept & (F.col("obligation") < NEGATIVE), event))).alias("negatives"),
    ]


def digest(kept: DataFrame) -> DataFrame:
    """One pass over an award's transactions; only terminations and negative amounts are kept as lists.

    An award's transactions lie apart before, so rows are dealt by award as they are, not as half-made digests, which are larger. Award keys
    share their first letters, so rows are put in order by the hash of the key first. Rows that lie by award already are folded where they are.
    """
    if _dealt(kept):
        return kept.groupBy(DEALT).agg(F.first("award_key").alias("award_key"), *folds()).drop(DEALT)
    return kept.repartition("award_key").groupBy(F.xxhash64("award_key").alias("_hash"), "award_key").agg(*folds()).drop("_hash")


def folded(txn: DataFrame, latest: list[str]) -> DataFrame:
    """Digest of each award and, of its latest transaction, the columns ``latest``, in one pass over transactions that lie by award. An award whose rows are all retracted has a ``mod_count`` of 0."""
    return _marked(txn.where("award_key is not null")).groupBy(DEALT).agg(F.first("award_key").alias("award_key"), *[_latest(F.col(c)).alias(c) for c in latest], *folds(F.col("_kept")))


def histories(rows: DataFrame, events: bool = False) -> DataFrame:
    """From record (``r``) and digest of each award: classified awards with their signals as the struct ``mods``, NULL where no transaction counts; with ``events``, the lists that :func:`evidence_rows` reads, too."""
    lists = ["terminations", "negatives"] if events else []
    d = mod_signals(rows, ("r", *lists))
    own = [c for c in d.columns if c not in ("award_key", "r", *lists)]
    told = d.select("r.*", F.when(F.col("mod_count") > 0, F.struct(*own)).alias("mods"), *lists)
    return classified(clean_awards(told, ("mods", *lists)))


def mod_signals(d: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Fifteen columns a award: each signal has its own basis, and none gates another."""
    last = F.try_element_at("terminations", F.lit(-1))
    years = F.datediff("last_action", "first_action")
    grown = F.col("first_ceiling_key") != F.col("last_ceiling_key")
    ratio = F.when(grown, F.expr("cast((cast(last_ceiling * 100 as decimal(38,0)) * 20000 + cast(first_ceiling * 100 as decimal(38,0))) div (cast(first_ceiling * 100 as decimal(38,0)) * 2) as long)"))
    pace = F.when((F.col("mod_count") >= 2) & (years > 0), F.expr("(mod_count * 7305000 + datediff(last_action, first_action)) div (2 * datediff(last_action, first_action))"))
    out = d.withColumns({"_t": last, "ceiling_growth": ratio, "velocity": pace})
    complete = F.col("end_of_record").isNotNull() & (F.col("end_of_record") <= F.date_add(F.col("_t.action_date"), GRACE_DAYS))
    early = F.exists("negatives", lambda e: (e["action_type_code"] != "K") & (e["obligation"] < DEOBLIGATION) & (e["action_date"] < F.col("first_planned_end")))
    measured = F.col("mod_count") >= 2
    return out.select(
        "award_key",
        "mod_count",
        F.col("_t").isNotNull().alias("terminated"),
        F.col("_t.action_type_code").alias("termination_code"),
        F.col("_t.action_date").alias("termination_date"),
        F.when(F.col("_t").isNull(), "none").when(F.coalesce(complete, F.lit(False)), "complete_likely").otherwise("partial_or_unclear").alias("termination_kind"),
        F.when(F.col("_t").isNull(), "none").otherwise("observed_code").alias("termination_basis"),
        "ceiling_growth",
        F.coalesce(F.col("ceiling_growth") > 15000, F.lit(False)).alias("ceiling_balloon"),
        F.when(F.col("ceiling_growth").isNull(), "insufficient").otherwise("measured").alias("ceiling_basis"),
        "velocity",
        F.when(F.col("velocity").isNull(), "n/a").when(F.col("velocity") > 100_000, "high").when(F.col("velocity") < 10_000, "low").otherwise("normal").alias("velocity_band"),
        F.coalesce(early, F.lit(False)).alias("has_deobligation"),
        F.coalesce(F.col("bridge_end") > F.date_add("first_planned_end", BRIDGE_DAYS), F.lit(False)).alias("bridge_flag"),
        F.when(F.col("first_planned_end").isNull(), "insufficient").otherwise("observed").alias("bridge_basis"),
        F.when(~measured, "single_transaction").when(F.col("first_action").isNull(), "insufficient").otherwise("measured").alias("mods_basis"),
        *also,
    )


def evidence_rows(d: DataFrame) -> DataFrame:
    """Terminations and negative amounts as rows, each once, with an id that is unique within the award."""
    events = d.select("award_key", F.explode(F.array_distinct(F.concat("terminations", "negatives"))).alias("e")).select("award_key", "e.*")
    once = events.dropDuplicates(["award_key", "mod_no", "action_date", "action_type_code", "obligation"])
    same = W.partitionBy("award_key", "mod_no").orderBy("action_date", "txn_key", "obligation")
    n = F.row_number().over(same)
    tid = F.concat_ws("-", "award_key", "mod_no", F.when(n > 1, n.cast("string")))
    return once.select("award_key", tid.alias("transaction_id"), "mod_no", "action_date", "action_type_code", "obligation")


def clean_awards(latest: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Typed and tidied award record with its missing-value notes."""
    d = rules.SPARK
    notes = F.concat_ws("; ", F.when(F.col("uei").isNull(), "missing UEI"), F.when(F.col("current_end").isNull() & F.col("potential_end").isNull(), "missing end date"), F.when(F.col("total_obligated").isNull(), "missing amount"))
    tidy = latest.select(
        F.col("award_key").alias("award_id"), "piid", "parent_idv", "award_type", "naics", "psc", "description", "state", "extent_code", "set_aside_code", "offers", "pricing_code", "size_code", "uei",
        F.expr(rules.normal_name(d, "agency")).alias("agency"),
        F.expr(rules.normal_name(d, "subagency")).alias("component"),
        F.expr(rules.normal_name(d, "recipient_name", vendor=True)).alias("vendor"),
        F.col("total_obligated").alias("value"), F.col("ceiling_total").alias("base_value"), F.col("action_date").alias("signed"), "pop_start", "current_end", "potential_end",
        notes.alias("notes"), *also,
    )
    return tidy.withColumn("n_notes", F.when(F.col("notes") == "", 0).otherwise(F.size(F.split("notes", "; "))))


def classified(clean: DataFrame) -> DataFrame:
    return clean.withColumns({k: F.expr(v) for k, v in rules.classification(rules.SPARK).items()})
