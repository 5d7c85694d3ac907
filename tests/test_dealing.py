"""Transactions are dealt once and narrow, and what queries share is written once."""

import json
import os

from pyspark.sql import functions as F

from awardforge.operators import candidates, history
from awardforge.plans import award_queries, domain, market_queries, report_queries
from awardforge.sources import tables

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """The exchanges of rows of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x for x in plan if "Exchange hashpartitioning" in x]


def without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")


def test_lines_are_dealt_by_part_and_by_award_only(spark):
    without_broadcast(spark)
    try:
        for df in (award_queries.histories(spark, SF), award_queries.cand(spark, SF), award_queries.awards(spark, SF)):
            dealt = exchanges(df)
            # lines by part and award, parts, orders by customer and award, customers (the nations of few rows may meet either way)
            assert sum("(l_" in x for x in dealt) == 2
            assert not any("award_key" in x or "txn_key" in x or "award_id" in x for x in dealt)
        for df in (award_queries.mods(spark, SF), history.kept_transactions(domain.transactions(spark, SF))):
            assert not any("award_key" in x or "txn_key" in x for x in exchanges(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_histories_equal_awards_and_signals_made_apart(spark):
    txn = domain.transactions(spark, SF).drop(history.DEALT)
    a = history.classified(history.clean_awards(history.latest_records(txn)))
    m = history.mod_signals(history.digest(history.kept_transactions(txn)))
    rows = lambda df: {json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect()}
    assert rows(award_queries.awards(spark, SF)) == rows(a)
    together, apart = award_queries.cand(spark, SF), candidates.build(a, m)
    assert together.columns == apart.columns and rows(together) == rows(apart)


def test_odd_rows_of_awards(spark, tmp_path):
    """A line without a part, an award whose lines are all retracted, an order that is there twice, a line that is there twice, an order without a customer."""
    for name in domain.TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines, orders = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("lineitem", "orders"))
    first = lines.orderBy("l_orderkey", "l_linenumber").limit(1)
    key = F.lit(9_000_000).cast("long")
    order = orders.limit(1).withColumn("o_orderkey", key)
    odd = [order, order, order.withColumn("o_orderkey", key + 1), order.withColumn("o_orderkey", key + 2).withColumn("o_custkey", F.lit(-1).cast("long"))]
    for x in odd:
        x.write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    own = lambda k, n, **c: first.withColumns({"l_orderkey": key + k, "l_linenumber": F.lit(n).cast("int"), "l_quantity": F.lit(9.0), "l_tax": F.lit(0.0)} | c)
    late = F.lit("2005-01-01").cast("timestamp")
    for x in [own(0, 1), own(0, 1), own(0, 2), own(0, 3, l_partkey=F.lit(-5).cast("long"), l_shipdate=late), own(1, 1, l_tax=F.lit(0.08), l_quantity=F.lit(7.0)), own(2, 1)]:
        x.select(*lines.columns).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    h = award_queries.histories(spark, str(tmp_path)).where(F.col("award_id").like("CONT_AWD_900000%")).select("award_id", "signed", "mods.mod_count").collect()
    got = {r.award_id: r for r in h}
    assert len(h) == 2 and set(got) == {"CONT_AWD_9000000", "CONT_AWD_9000001"}
    assert got["CONT_AWD_9000000"].mod_count == 2 and got["CONT_AWD_9000000"].signed.year < 2005
    assert got["CONT_AWD_9000001"].mod_count is None
    c = award_queries.cand(spark, str(tmp_path)).where("award_id = 'CONT_AWD_9000001'").select("mods_basis", "terminated").collect()
    assert not c or (c[0].mods_basis, c[0].terminated) == ("insufficient", False)


def test_shuffles_of_a_written_table_go_at_its_end(spark):
    before = spark.conf.get(tables.CLEANED)
    t = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum(1 for f in _files(t) if f.startswith("shuffle_"))
    there = count()
    x = tables.written(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 3).alias("k")).count(), "cleaned")
    assert {tuple(r) for r in x.collect()} == {(0, 334), (1, 333), (2, 333)}
    assert count() <= there and spark.conf.get(tables.CLEANED) == before


def _files(disk):
    out = []
    for folder in disk.localDirsString():
        for _, _, files in os.walk(folder):
            out += files
    return out


def times_written(spark, monkeypatch, query):
    """How often a query plans to read the table of lines, over all that it writes and returns; nothing is run."""
    n, txn, hist = [0], domain.transactions, domain.histories
    monkeypatch.setattr(tables, "written", lambda df, tag: spark.createDataFrame([], df.schema))
    monkeypatch.setattr(tables, "write_star", lambda *a: None)
    monkeypatch.setattr(tables, "read_star", lambda *a: {})
    monkeypatch.setattr(domain, "transactions", lambda *a: (n.__setitem__(0, n[0] + 1), txn(*a))[1])
    monkeypatch.setattr(domain, "histories", lambda *a: (n.__setitem__(0, n[0] + 1), hist(*a))[1])
    query(spark, SF)
    monkeypatch.undo()
    return n[0]


def test_queries_read_the_lines_once(spark, monkeypatch):
    for query in (report_queries.k1, report_queries.m3, report_queries.j8, report_queries.f12, report_queries.f12b, report_queries.h17, report_queries.a5, market_queries.f8b, market_queries.j5, market_queries.i4):
        assert times_written(spark, monkeypatch, query) == 1, query.__name__
    # the count of transactions is taken apart from the digest, on purpose
    assert times_written(spark, monkeypatch, report_queries.m1b) == 2
