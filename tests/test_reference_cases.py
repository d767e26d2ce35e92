"""The reusable unit cases of the original test module, as exact-value tests."""

from pyspark.sql import functions as F

from peakscreen.operators import cleaning as oc
from peakscreen.operators import labeling as lb
from peakscreen.sources import instrument as ins


def test_correct_spelling(spark):
    df = spark.createDataFrame([("Marta",), ("Martha",), ("Marty",)], "ComponentName string")
    out = [r[0] for r in oc.correct_spelling(df, "ComponentName", "Marta", "Martha").collect()]
    assert out == ["Martha", "Martha", "Marty"]
    out2 = oc.correct_spelling(df, "ComponentName", "Marty", "Martha").collect()
    assert out2[2][0] == "Martha"


def test_reduce_peaks_shape(spark):
    df = spark.createDataFrame(
        [(0.0, "Unknown", 1.0, 1), (1.0, "Unknown", 0.0, 2), (2.0, "Standard", 2.0, 3)],
        "`Analyte Retention Time (min)` double, `Sample Type` string, "
        "`Relative Retention Time` double, `Drop Me` long")
    cols = ["Analyte Retention Time (min)", "Relative Retention Time", "Sample Type"]
    out = oc.reduce_peaks(oc.project(df, cols))
    assert out.count() == 0 and len(out.columns) == 3


def test_reduce_keeps_null_rt(spark):
    df = spark.createDataFrame([(None, "Unknown", None), (1.0, "Unknown", 1.0)],
                               "`Analyte Retention Time (min)` double, `Sample Type` string, "
                               "`Relative Retention Time` double")
    assert oc.reduce_peaks(df).count() == 2


def test_clean_names(spark):
    df = spark.createDataFrame(
        [("20090501-10ABC", "Too Clever-1"), ("RM20090501-10", "Not Clever Enough-2"),
         ("12320090501-10", "Very Clever-1"), ("20090501-10123", "Just Odd-2")],
        "`Sample Name` string, `Analyte Peak Name` string")
    s = oc.clean_sample_names(df)
    assert {r[0] for r in s.select("sample_name").distinct().collect()} == {"20090501-10"}
    a = oc.clean_analyte_names(s, remove=["Too ", "Not ", " Enough", "Very ", "Just "],
                               merge={"Odd": "Spinosad"})
    assert (a.count(), len(a.columns)) == (4, 4)
    assert {r[0] for r in a.select("analyte").distinct().collect()} == {"Clever", "Spinosad"}


def test_sample_name_drops_nonmatching_and_null(spark):
    df = spark.createDataFrame([("abc",), (None,), ("x20200101-01",)], "`Sample Name` string")
    assert [r[0] for r in oc.clean_sample_names(df).select("sample_name").collect()] == ["20200101-01"]


def test_short_analyte_names(spark):
    df = spark.createDataFrame([("ab",), ("a",), (None,), ("abc",)], "`Analyte Peak Name` string")
    out = [r[0] for r in oc.clean_analyte_names(df, remove=[], merge={}).select("analyte").collect()]
    assert out == ["", "", None, "a"]


def test_merge_reports(spark):
    full = spark.createDataFrame([("Sample1", "Analyte1"), ("Sample2", "Analyte1")],
                                 "sample_name string, analyte string")
    rep = spark.createDataFrame([(2.0, "Sample1", "Analyte1")],
                                "`Numeric Result` double, SampleCode2 string, ComponentName2 string")
    out = lb.merge_reports(full, rep).orderBy("sample_name")
    assert (out.count(), len(out.columns)) == (2, 3)
    assert [r["reported"] for r in out.collect()] == [1, 0]


def test_merge_reports_zero_result_and_fanout(spark):
    full = spark.createDataFrame([("S1", "A"), ("S2", "A")], "sample_name string, analyte string")
    rep = spark.createDataFrame([(0.0, "S1", "A"), (3.0, "S2", "A"), (4.0, "S2", "A")],
                                "`Numeric Result` double, SampleCode2 string, ComponentName2 string")
    out = lb.merge_reports(full, rep)
    assert out.count() == 3                      # duplicate report keys fan out
    assert out.where(F.col("sample_name") == "S1").first()["reported"] == 0
    dd = lb.merge_reports(full, rep, dedupe=True)
    assert dd.count() == 2


def test_file_without_header_is_rejected(spark, tmpdir_path):
    # 11 data lines of 81 fields and no header line, like the shipped fake export.
    line = "\t".join(["ICB", "", "Solvent"] + ["0"] * 78)
    with open(f"{tmpdir_path}/fake_instrument_data.txt", "w") as f:
        f.write("\n".join([line] * 11) + "\n")
    parsed = ins.read_instrument_dir(spark, tmpdir_path)
    assert parsed.rows.count() == 0
    rej = parsed.rejected.collect()
    assert len(rej) == 1 and "no header" in rej[0]["reason"]
