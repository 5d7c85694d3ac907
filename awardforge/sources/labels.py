"""Label sheets and their contract: column order, lists of values, dates and rules across fields, checked in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardforge.sources.tables import day

# Columns and lists of the two sheets.
LINK_COLUMNS = "case_id sampled_snapshot_date candidate_id linked_notice_id link_confidence link_reason candidate_piid candidate_title candidate_subagency candidate_naics notice_title notice_solicitation_number notice_posted_date candidate_source_url notice_source_url label labeler_notes labeled_date".split()
OUTCOME_COLUMNS = "case_id sample_set sampled_snapshot_date candidate_id predecessor_piid predecessor_title subagency naics psc potential_end_date value_band vehicle_kind predecessor_source_url outcome_label undeterminable_reason label_confidence notice_anchored evidence_notice_id evidence_url_1 evidence_url_2 unmask_performed unmask_date incumbent_retained_observed label_changed_after_unmask labeler_notes labeled_date".split()
OUTCOMES = "recompete_unchanged extension_bridge vehicle_migration consolidation_or_split ended sole_source_follow_on undeterminable successor_out_of_scope".split()
LISTS = {
    "link": {"label": "correct incorrect unsure".split()},
    "outcome": {
        "sample_set": "stratified top50 both carried".split(),
        "outcome_label": OUTCOMES,
        "undeterminable_reason": "no_notice_found conflicting_evidence successor_ambiguous insufficient_history".split(),
        "label_confidence": "high medium low".split(),
        "notice_anchored": ["Y", "N"],
        "unmask_performed": ["Y", "N"],
        "label_changed_after_unmask": ["Y", "N"],
        "incumbent_retained_observed": "yes no unclear".split(),
    },
}
DATES = {"link": "sampled_snapshot_date notice_posted_date labeled_date".split(), "outcome": "sampled_snapshot_date potential_end_date unmask_date labeled_date".split()}
COLUMNS = {"link": LINK_COLUMNS, "outcome": OUTCOME_COLUMNS}
#: Rules across the fields of an outcome, over trimmed values: what breaks each.
ACROSS = {
    "reason missing": "outcome_label = 'undeterminable' AND undeterminable_reason = ''",
    "reason without cause": "outcome_label <> 'undeterminable' AND undeterminable_reason <> ''",
    "high without notice": "notice_anchored = 'N' AND label_confidence = 'high'",
    "unmask incomplete": "unmask_performed = 'Y' AND (unmask_date = '' OR incumbent_retained_observed = '')",
    "unmask not performed": "unmask_performed <> 'Y' AND (unmask_date <> '' OR incumbent_retained_observed <> '')",
    "change not explained": "label_changed_after_unmask = 'Y' AND labeler_notes = ''",
}


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet as text columns with ``row``, its place; other columns or another order are an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if raw.columns != COLUMNS[sheet]:
        wrong = sorted(set(COLUMNS[sheet]) ^ set(raw.columns)) or "their order"
        raise ValueError(f"{sheet} labels: columns differ in {wrong}")
    return raw.withColumn("row", F.monotonically_increasing_id())


def violations(labels: DataFrame, sheet: str) -> DataFrame:
    """``(rule, row, case_id)`` for every rule that a row breaks. Each row is read once: its broken rules are an array that is unfolded."""
    told = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in COLUMNS[sheet]}
    x = labels.select(*told.values(), "row")
    broken = [F.when(F.col("case_id") == "", "case_id blank")]
    broken += [F.when((F.col(c) != "") & ~F.col(c).isin(*values), f"{c} not in its list") for c, values in LISTS[sheet].items()]
    broken += [F.when((F.col(c) != "") & day(F.col(c)).isNull(), f"{c} is no date") for c in DATES[sheet]]
    if sheet == "outcome":
        broken += [F.when(F.expr(condition), rule) for rule, condition in ACROSS.items()]
    one = x.select("row", "case_id", F.explode(F.array_compact(F.array(*broken))).alias("rule"))
    repeats = x.where("case_id <> ''").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")).where("n > 1")
    return one.select("rule", "row", "case_id").unionByName(repeats.select(F.lit("case_id repeated").alias("rule"), "row", "case_id"))


def summary(found: DataFrame) -> DataFrame:
    """Each broken rule with how many rows break it and the first of them."""
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min_by("case_id", F.struct("row", "case_id")).alias("first_case"))


def refuse_broken(labels: DataFrame, sheet: str) -> DataFrame:
    """The labels, if they keep the contract; else an error that names the first broken rule and its row."""
    first = summary(violations(labels, sheet)).orderBy("rule").first()
    if first:
        raise ValueError(f"{sheet} labels: {first['rule']} in {first['n']} rows, first in case {first['first_case']!r}")
    return labels
