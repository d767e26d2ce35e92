"""Operators without a table counterpart on the driver's data (T rows of the README table)."""

import os

from pyspark.sql import functions as F

from peakscreen.functions.decisions import round_half_even
from peakscreen.functions.names import display_name
from peakscreen.operators import evaluation as ev
from peakscreen.operators import features as fe
from peakscreen.operators import modeling as md
from peakscreen.operators import sampling as sm
from peakscreen.sources import tables


def test_read_reports_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "rep.csv")
    with open(p, "w") as f:
        f.write("SampleCode,ComponentName,Numeric Result\n20200101-01A,Imadacloprid_Result,0.5\n")
    r = tables.read_reports(spark, p).first()
    assert r["SampleCode"] == "20200101-01A" and r["Numeric Result"] == 0.5


def test_table_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "row_id long, x double")
    tables.write_table(df, f"{tmpdir_path}/t")
    assert sorted(tables.read_table(spark, f"{tmpdir_path}/t").collect()) == sorted(df.collect())


def test_model_roundtrip(spark, tmpdir_path):
    rows = [(i, float(i % 7), float(i % 3), 1 if i % 7 > 3 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, reported int")
    fm = md.fit_model(df, ["a", "b"], "logistic")
    tables.save_model(fm.model, f"{tmpdir_path}/m")
    back = tables.load_model(f"{tmpdir_path}/m")
    s1 = md.score(fm, df).orderBy("row_id").select("probas").collect()
    s2 = md.score(md.FittedModel("x", back, ["a", "b"]), df).orderBy("row_id").select("probas").collect()
    assert s1 == s2
    assert all(0.0 <= r[0] <= 1.0 for r in s1)


def test_single_analyte(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "analyte string, x double")
    out = fe.single_analyte(df, "A")
    assert out.columns == ["x", "analyte_A"] and out.collect()[0]["analyte_A"] == 1


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (0.49,)], "x double")
    assert [r[0] for r in df.select(round_half_even("x")).collect()] == [0.0, 2.0, 2.0, 0.0]


def test_display_name(spark):
    df = spark.createDataFrame([("rt_diff",), ("Analyte Start Scan",), ("zzz",)], "f string")
    assert [r[0] for r in df.select(display_name("f")).collect()] == \
        ["RT Difference", "Analyte Start Scan", "zzz"]


def test_random_split_sizes(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "row_id")
    out = sm.random_split(df, "row_id", 0.33, 42)
    assert out.where(F.col("split") == "test").count() == 330
    again = sm.random_split(df.repartition(7), "row_id", 0.33, 42)
    a = {r[0] for r in out.where(F.col("split") == "test").select("row_id").collect()}
    b = {r[0] for r in again.where(F.col("split") == "test").select("row_id").collect()}
    assert a == b


def test_feature_ranking_parity(spark):
    names = [f"f{i}" for i in range(12)] + ["analyte_X"]
    weights = [float(i) for i in range(12)] + [-20.0]
    top = ev.feature_ranking(spark, names, weights, top=10).orderBy("rank").collect()
    assert top[0]["feature"] == "analyte_X" and top[0]["no_analyte_weight"] == 0.0
    assert top[0]["negative"] and top[0]["positive_weight"] == 0.0
    par = ev.feature_ranking(spark, names, weights, top=10, parity=True).orderBy("rank").collect()
    assert [r["rank"] for r in par] == list(range(2, 12))     # the strongest feature is skipped


def test_feature_set_errors_and_failure_samples(spark):
    import pytest
    from peakscreen.operators import quality as qa
    df = spark.createDataFrame([(1, 2.0, 1), (2, None, 0)], "row_id long, x double, analyte_A int")
    with pytest.raises(ValueError):
        fe.filter_cols(df, "bogus")
    with pytest.raises(KeyError):
        fe.drop_cols(df, ["nope"])
    assert fe.filter_cols(df, "no_analyte").columns == ["row_id", "x"]
    bad = qa.failure_samples(df, qa.not_null("x")).collect()
    assert bad == [(None,)] or [tuple(r) for r in bad] == [(None,)]
