"""Expectation suite and batch decisions on small frames."""

from peakscreen import schema as S
from peakscreen.operators import batch_qc as qc
from peakscreen.operators import quality as qa


def test_expectation_suite(spark):
    df = spark.createDataFrame(
        [("20200101-01", 1, 2.0, "Abamectin"), (None, 0, 15.0, "Abamectine"), ("x", 2, 3.0, None)],
        f"sample_name string, reported int, `{S.RT}` double, analyte string")
    res = {r["expectation"]: r for r in qa.run_suite(df, qa.default_suite()).collect()}
    assert res["sample_name not null"]["unexpected"] == 1
    assert res["reported in set"]["unexpected"] == 1
    assert res["reported = 1 for at least 1%"]["passed"]
    assert res[f"{S.RT} between 0 and 14"]["unexpected"] == 1
    assert res["analyte in set"]["unexpected"] == 1
    full = {r["expectation"]: r for r in qa.run_suite(
        df, qa.default_suite(full_match=True)).collect()}
    assert full["sample_name matches [0-9]{8}\\-[0-9]{2}"]["unexpected"] == 1


def test_decisions_and_controls(spark):
    rows = [("QC1", "Quality Control", "A-1", 10.0, 2.0, 0.3),     # missed control
            ("B1", "Blank", "A-1", 5.0, 2.0, 0.9),                 # dirty blank
            ("U1", "Unknown", "A-1", 5.0, 2.0, 0.41),              # review
            ("U2", "Unknown", "A-1", 5.0, 0.0, 0.99),              # no RT -> 0
            ("X", "Other", "A-1", 5.0, 2.0, 0.9)]                  # expected null
    df = spark.createDataFrame(rows, f"`{S.SAMPLE_NAME}` string, `{S.SAMPLE_TYPE}` string, "
                                     f"`{S.PEAK_NAME}` string, `{S.PEAK_AREA}` double, "
                                     f"`{S.RT}` double, probs double")
    d = qc.add_decisions(df)
    got = {r[S.SAMPLE_NAME]: r for r in d.collect()}
    assert got["QC1"]["false_neg"] == 1 and got["B1"]["false_pos"] == 1
    assert got["U1"]["sample_pred"] == 1 and got["U2"]["predict"] == 0
    assert got["X"]["expected"] is None and got["X"]["false_pos"] == 0
    fn, fp = qc.control_lists(d)
    assert [r[0] for r in fn.collect()] == ["QC1"] and [r[0] for r in fp.collect()] == ["B1"]
    assert [r[0] for r in qc.review_list(d).collect()] == ["U1"]
    st = qc.control_status(d.withColumn("source_file", d[S.SAMPLE_TYPE].substr(1, 0))).first()
    assert (st["failed_controls"], st["dirty_blanks"], st["controls_pass"]) == (1, 1, False)
