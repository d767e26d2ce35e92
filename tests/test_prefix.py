"""Distributed running totals equal a plain window, with hot keys and any block count."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from peakscreen.operators.prefix import descending, running_total


@pytest.mark.parametrize("n_blocks", [1, 3, 7])
def test_matches_window_with_hot_key(spark, n_blocks):
    rows = [(i, 5 if i % 3 == 0 else i, "hot" if i % 2 else f"g{i % 5}", (i * 37) % 11 - 5)
            for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, t long, grp string, v long")
    out = running_total(df, ["v"], ["t", "row_id"], ["grp"], n_blocks=n_blocks)
    w = Window.partitionBy("grp").orderBy("t", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.sum("v").over(w))
    j = out.join(ref.select("row_id", "ref"), "row_id")
    assert j.count() == 600
    assert j.where(F.col("v_cum") != F.col("ref")).count() == 0
    glob = running_total(df, ["v"], ["t", "row_id"], n_blocks=n_blocks)
    w2 = Window.orderBy("t", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    ref2 = df.withColumn("ref", F.sum("v").over(w2))
    j2 = glob.join(ref2.select("row_id", "ref"), "row_id")
    assert j2.where(F.col("v_cum") != F.col("ref")).count() == 0


def test_descending_and_nulls(spark):
    df = spark.createDataFrame([(1, 3.0, 1), (2, 2.0, None), (3, 1.0, 4)], "row_id long, s double, v long")
    out = running_total(df, ["v"], descending("s"), n_blocks=2)
    got = {r["row_id"]: r["v_cum"] for r in out.collect()}
    assert got == {1: 1, 2: 1, 3: 5}


def test_aqe_sized_blocks_stay_ordered(spark):
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = [(i, 7 if i % 3 == 0 else i, (i * 13) % 5) for i in range(3000)]
        df = spark.createDataFrame(rows, "row_id long, t long, v long")
        out = running_total(df, ["v"], ["t", "row_id"])        # blocks follow the shuffle partitions
        w = Window.orderBy("t", "row_id").rowsBetween(Window.unboundedPreceding, 0)
        ref = df.withColumn("ref", F.sum("v").over(w))
        j = out.join(ref.select("row_id", "ref"), "row_id")
        assert j.count() == 3000 and j.where(F.col("v_cum") != F.col("ref")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)


def test_window_engine_matches(spark):
    rows = [(i, 5 if i % 3 == 0 else i, "hot" if i % 2 else f"g{i % 5}", (i * 37) % 11 - 5)
            for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, t long, grp string, v long")
    a = running_total(df, ["v"], ["t", "row_id"], ["grp"], n_blocks=5)
    b = running_total(df, ["v"], ["t", "row_id"], ["grp"], n_blocks=5)
    j = a.select("row_id", F.col("v_cum").alias("x")).join(b.select("row_id", "v_cum"), "row_id")
    assert j.count() == 600 and j.where(F.col("x") != F.col("v_cum")).count() == 0
    g = running_total(df, ["v"], ["t", "row_id"], n_blocks=4)
    w2 = Window.orderBy("t", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.sum("v").over(w2))
    assert g.join(ref.select("row_id", "ref"), "row_id").where(F.col("v_cum") != F.col("ref")).count() == 0


def test_exact_longs_null_groups_and_late_timestamps(spark):
    """Nullable longs above 2^53, null groups and years beyond nanosecond range keep their values."""
    big = 9007199254740993
    df = spark.sql(f"""SELECT * FROM VALUES (1, {big}L, NULL, timestamp'3000-01-01'), (2, NULL, NULL, timestamp'3000-01-02'),
        (3, {big + 2}L, NULL, timestamp'3000-01-03'), (4, 5L, 'a', timestamp'2020-01-01') AS t(id, v, grp, ts)""")
    out = {r["id"]: r for r in running_total(df, ["v"], ["ts", "id"], ["grp"], n_blocks=3).collect()}
    assert [out[i]["v_cum"] for i in (1, 2, 3, 4)] == [big, big, 2 * big + 2, 5]
    assert [out[i]["v"] for i in (1, 2, 3)] == [big, None, big + 2] and out[3]["ts"].year == 3000


def test_descending_sorts_as_spark_does(spark):
    rows = [(i, v) for i, v in enumerate([1.0, None, float("nan"), float("inf"), -2.0, float("-inf"), 0.0, None])]
    df = spark.createDataFrame(rows, "id long, s double")
    plain = [r.id for r in df.orderBy(F.col("s").desc(), "id").collect()]
    assert plain == [r.id for r in df.orderBy(*descending("s"), "id").collect()]


def test_one_shuffle_of_the_rows_and_no_checkpoint(spark):
    rows = [(i, i % 7, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, t long, v long")
    out = running_total(df, ["v"], ["t", "row_id"], n_blocks=8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "RepartitionByExpression" not in plan
    a = {r.row_id: r.v_cum for r in out.collect()}
    assert a == {r.row_id: r.v_cum for r in running_total(df.repartition(13), ["v"], ["t", "row_id"], n_blocks=5).collect()}
