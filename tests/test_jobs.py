"""End-to-end jobs on generated export files: labelled table, feature table, scoring, profit."""

import os

from pyspark.sql import functions as F

from peakscreen import schema as S
from peakscreen.operators import modeling as md
from peakscreen.plans import jobs

HEADER = S.PEAK_COLUMNS + [S.ACQUISITION_DATE]


def _export(path, name, rows):
    with open(os.path.join(path, name), "w") as f:
        f.write("Peak Name: Myclobutanil d4\nComment\n\n" + "\t".join(HEADER) + "\n")
        for r in rows:
            f.write("\t".join(str(r.get(h, "1.0")) for h in HEADER) + "\n")


def _rows(day, n):
    out = []
    for i in range(n):
        hit = i % 4 == 0
        out.append({S.SAMPLE_NAME: f"2020010{day}-{i:02d}A", S.SAMPLE_TYPE: "Unknown" if i % 5 else "Blank",
                    S.PEAK_NAME: ["Imazalil 1", "Spinosyn A-1", "cis-Permethrin 2"][i % 3],
                    S.PEAK_AREA: 1000 + (5000 if hit else 0) + i, S.RT: 0.0 if i % 7 == 0 else 2.5,
                    S.EXPECTED_RT: 2.4, S.RRT: 1.0, S.AREA_RATIO: "#DIV/0!" if i % 6 == 0 else "0.5",
                    S.ACQUISITION_DATE: f"1/{day}/2020 {1 + i % 11}:0{i % 10}:00 PM"})
    return out


def test_feature_table_and_scoring(spark, tmpdir_path):
    exp = os.path.join(tmpdir_path, "exports")
    os.makedirs(exp)
    _export(exp, "a.txt", _rows(1, 40))
    _export(exp, "b.txt", _rows(2, 40))
    rep = os.path.join(tmpdir_path, "rep.csv")
    with open(rep, "w") as f:
        f.write("SampleCode,ComponentName,Numeric Result\n")
        for day in (1, 2):
            for i in range(0, 40, 4):
                name = ["Imazalil", "Spinosad", "Permethrin"][i % 3]
                f.write(f"2020010{day}-{i:02d}X,{name}_Result,{1.5 if i % 8 else 0.0}\n")
    labelled, rejected = jobs.labelled_table(spark, exp, rep)
    assert rejected.count() == 0
    # integrated unknown peaks only: RT != 0 and type Unknown
    expected_rows = sum(1 for d in (1, 2) for r in _rows(d, 40)
                        if r[S.RT] != 0.0 and r[S.SAMPLE_TYPE] == "Unknown")
    assert labelled.count() == expected_rows
    assert set(r[0] for r in labelled.select("analyte").distinct().collect()) <= {
        "Imazalil", "Spinosad", "Permethrin"}
    out = jobs.feature_table_job(spark, exp, rep, f"{tmpdir_path}/feat", f"{tmpdir_path}/info")
    assert out["n_rows"] == expected_rows and out["n_reported"] > 0
    data = jobs.FeatureData(f"{tmpdir_path}/feat")
    t = data.table(spark)
    assert "line_no" not in t.columns and "analyte_Spinosad" in t.columns and "rt_diff" in t.columns
    assert len(data.table(spark, "limited_no_analyte").columns) < len(t.columns)
    train, test = data.split(spark)
    assert train.count() + test.count() == expected_rows
    fm = md.fit_model(t, md_features(t), "logistic")
    ev = jobs.evaluate_batch(spark, exp, fm)
    st = ev["status"].collect()
    assert len(st) == 2
    prof = jobs.batch_profit_job(spark, exp, fm)
    assert prof.count() == 80
    last = prof.orderBy(F.col("acquired_at").desc(), F.col("row_id").desc()).first()
    assert last["profit_total_cents"] == prof.agg(F.sum("profit_cents")).first()[0]


def md_features(t):
    from peakscreen.operators.features import feature_columns
    return feature_columns(t, "reported", ("row_id",))
