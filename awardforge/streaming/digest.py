"""The modification fold as a stream: each transaction once, however often and in whatever order its files arrive.

The keys of all transactions and the digest of each award are the state of Spark's own de-duplication and aggregation, held
on the executors' disks. Where a ``retention`` is given, one row for each award holds its digest with its keys instead, folded by a Python call
an award and batch; keys are then forgotten once an award has been quiet for that long, as no file is delivered again
after that, while the digest stays. What a batch changed comes out as the award's new digest, so the newest version of an award is
the fold over all that has arrived.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardforge.operators.history import NEGATIVE, TERMINATIONS, folds

#: What the fold reads of a transaction.
FIELDS = ["award_key", "txn_key", "mod_no", "action_date", "action_type_code", "delete_ind", "obligation", "ceiling_total", "potential_end", "current_end", "extent_code"]
AMOUNTS = ("obligation", "ceiling_total")
Transaction = namedtuple("Transaction", FIELDS)
EVENT = "array<struct<action_date:date,mod_no:string,txn_key:string,action_type_code:string,obligation:decimal(18,2)>>"
OUT = {
    "award_key": "string", "mod_count": "long", "first_action": "string", "last_action": "string", "obligation_cents": "long",
    "first_ceiling_cents": "long", "last_ceiling_cents": "long", "first_ceiling_key": "string", "last_ceiling_key": "string", "first_planned_end": "string", "end_of_record": "string", "bridge_end": "string",
    "terminations": "string", "negatives": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in OUT.items())


def _at(state: dict, name: str, order: list, value, first: bool) -> None:
    """Keep the value with the least or greatest order of all seen."""
    old = state.get(name)
    if old is None or (order < old[0] if first else order > old[0]):
        state[name] = [order, value]


def fold(state: dict, rows) -> bool:
    """Fold transactions into an award's state; whether anything was new. Rows without a key always count, retracted ones never."""
    changed = False
    seen = state.setdefault("seen", {})
    for r in map(Transaction._make, rows):
        if (r.delete_ind or "") == "D":
            continue
        if r.txn_key:
            if r.txn_key in seen:
                continue
            seen[r.txn_key] = 1
        changed = True
        # an undated transaction comes before all dated ones, as in the batch fold
        order = [r.action_date or "", r.mod_no or "", r.txn_key or ""]
        state["mod_count"] = state.get("mod_count", 0) + 1
        state["obligation"] = state.get("obligation", 0) + (r.obligation or 0)
        if r.action_date:
            state["first_action"] = min(state.get("first_action") or r.action_date, r.action_date)
            state["last_action"] = max(state.get("last_action") or r.action_date, r.action_date)
        if r.ceiling_total is not None and r.ceiling_total > 0:
            _at(state, "first_ceiling", order, [r.ceiling_total, r.txn_key], True)
            _at(state, "last_ceiling", order, [r.ceiling_total, r.txn_key], False)
        if r.potential_end:
            _at(state, "first_planned_end", order, r.potential_end, True)
        if r.current_end:
            _at(state, "end_of_record", order, r.current_end, False)
            if r.extent_code in ("B", "C", "G"):
                state["bridge_end"] = max(state.get("bridge_end") or r.current_end, r.current_end)
        event = [r.action_date, r.mod_no, r.txn_key, r.action_type_code, r.obligation]
        if r.action_type_code in TERMINATIONS:
            state.setdefault("terminations", []).append(event)
        if r.obligation is not None and r.obligation < 100 * NEGATIVE:
            state.setdefault("negatives", []).append(event)
    return changed


def _row(key: str, s: dict) -> tuple:
    ceiling = lambda name, k: (s.get(name) or [None, [None, None]])[1][k]
    at = lambda name: (s.get(name) or [None, None])[1]
    ordered = lambda name: json.dumps(sorted(s.get(name, []), key=lambda e: [x or "" for x in e[:4]]))
    return (
        key, s.get("mod_count", 0), s.get("first_action"), s.get("last_action"), s.get("obligation", 0), ceiling("first_ceiling", 0), ceiling("last_ceiling", 0), ceiling("first_ceiling", 1), ceiling("last_ceiling", 1),
        at("first_planned_end"), at("end_of_record"), s.get("bridge_end"), ordered("terminations"), ordered("negatives"),
    )


def _update(retention_ms: int):
    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            # quiet for long: what was folded stays, the keys go
            held["seen"] = {}
            state.update((json.dumps(held),))
            return
        changed = False
        for frame in frames:
            # an amount that is missing comes as a NaN
            told = ([None if x != x else int(x) for x in frame[c]] if c in AMOUNTS else frame[c].tolist() for c in FIELDS)
            changed |= fold(held, zip(*told, strict=True))
        state.update((json.dumps(held),))
        state.setTimeoutDuration(retention_ms)
        if changed:
            yield pd.DataFrame([_row(key[0], held)], columns=list(OUT), dtype=object)

    return update


def _plain(txn: DataFrame) -> DataFrame:
    """Dates as ISO text and amounts as whole cents: what a JSON state holds exactly."""
    cents = lambda c: (F.col(c) * 100).cast("long").alias(c)
    how = {"obligation": cents, "ceiling_total": cents} | {c: (lambda c: F.col(c).cast("string").alias(c)) for c in ("action_date", "potential_end", "current_end")}
    return txn.select(*[how[c](c) if c in how else F.col(c) for c in FIELDS])


def _typed(out: DataFrame) -> DataFrame:
    """The digest's own types again, the same columns as ``history.digest``."""
    money = lambda c: (F.col(f"{c}_cents").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias(c)
    date = lambda c: F.col(c).cast("date").alias(c)
    parsed = lambda c: F.from_json(c, "array<array<string>>")
    events = lambda c: F.transform(parsed(c), lambda e: F.struct(e[0].cast("date").alias("action_date"), e[1].alias("mod_no"), e[2].alias("txn_key"), e[3].alias("action_type_code"), (e[4].cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("obligation"))).cast(EVENT).alias(c)
    return out.select(
        "award_key", "mod_count", date("first_action"), date("last_action"), money("obligation"), money("first_ceiling"), money("last_ceiling"), "first_ceiling_key", "last_ceiling_key",
        date("first_planned_end"), date("end_of_record"), date("bridge_end"), events("terminations"), events("negatives"),
    )


def folded(txn: DataFrame, retention_ms: int) -> DataFrame:
    """A stream of transactions to a stream of digests (update mode)."""
    return _plain(txn).groupBy("award_key").applyInPandasWithState(_update(retention_ms), SCHEMA, "digest string", "update", "ProcessingTimeTimeout")


def aggregated(txn: DataFrame) -> DataFrame:
    """The same in whole by Spark's own state: each key of an award once, then one aggregation an award. Rows without a key always count, so each gets a key of its own."""
    key = F.coalesce(F.nullif(F.col("txn_key"), F.lit("")), F.concat(F.lit("no key "), F.expr("uuid()")))
    once = txn.where("coalesce(delete_ind, '') <> 'D'").withColumn("_key", key).dropDuplicates(["award_key", "_key"])
    return once.groupBy("award_key").agg(*folds(), F.sum(F.coalesce("obligation", F.lit(0))).cast("decimal(18,2)").alias("obligation"))


_STATE = "spark.sql.streaming.stateStore"
#: A timer asks for batches without data, of which a run over what is there would never see the end. State lies on disk, as it grows with the keys.
SETTINGS = {
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
}


def stream_digest(spark: SparkSession, folder: str, schema, checkpoint: str, out: str, files: int = 4, retention_ms: int | None = None) -> None:
    """Fold the files of ``folder`` that have arrived into ``out``, batch by batch. A batch that is repeated after a failure overwrites its own part only."""
    txn = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    digests = aggregated(txn) if retention_ms is None else folded(txn, retention_ms)

    def put(df: DataFrame, batch: int) -> None:
        (df if retention_ms is None else _typed(df)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        digests.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _newest(rows: DataFrame, *also: str) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("award_key", "batch")]
    return rows.groupBy("award_key").agg(F.max_by(F.struct(*kept, *also), "batch").alias("r")).select("award_key", "r.*")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest digest of each award."""
    return _newest(spark.read.parquet(out))


def compact(spark: SparkSession, out: str, to: str) -> None:
    """Write one version of each award, so that readers need not pass over all batches; batches up to the one compacted can go then."""
    _newest(spark.read.parquet(out), "batch").write.partitionBy("batch").parquet(to)
