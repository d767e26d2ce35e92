"""Instrument export reader on generated files (every variant listed in FIXTURES.md)."""

import os

from pyspark.sql import functions as F

from peakscreen import schema as S
from peakscreen.sources import instrument as ins

PREAMBLE = ["Peak Name: Myclobutanil d4", "Use as Internal Standard: no", "Comment: batch 7"]


def _row(values: dict, header: list[str]) -> str:
    return "\t".join(str(values.get(h, "0")) for h in header)


def _header(order=None, drop=()):
    cols = [c for c in (order or S.PEAK_COLUMNS + ["Acquisition Date", "Sample ID"]) if c not in drop]
    return cols


def _write(path, name, header, rows, preamble=PREAMBLE, newline="\n", blank=True, trailing=True):
    lines = list(preamble) + ([""] if blank else []) + ["\t".join(header)] + [_row(r, header) for r in rows]
    text = newline.join(lines) + (newline if trailing else "")
    with open(os.path.join(path, name), "w", newline="") as f:
        f.write(text)


ROW1 = {S.SAMPLE_NAME: "20200615-01A", S.SAMPLE_TYPE: "Unknown", S.PEAK_NAME: "Imazalil 1",
        S.PEAK_AREA: "1200", S.RT: "2.90", S.EXPECTED_RT: "2.89", S.RRT: "1.00",
        S.AREA_RATIO: "#DIV/0!", S.HEIGHT_RATIO: "0.5", S.BASELINE_SLOPE: "0.00e+000"}
ROW2 = {S.SAMPLE_NAME: "20200615-02", S.SAMPLE_TYPE: "Blank", S.PEAK_NAME: "Spinosyn A-2",
        S.PEAK_AREA: "N/A", S.RT: "", S.EXPECTED_RT: "1d", S.RRT: "0"}


def test_valid_file_projects_by_name(spark, tmpdir_path):
    _write(tmpdir_path, "a.txt", _header(), [ROW1, ROW2])
    parsed = ins.read_instrument_dir(spark, tmpdir_path)
    rows = parsed.rows.orderBy("line_no").collect()
    assert parsed.rejected.count() == 0
    assert len(rows) == 2
    assert rows[0][S.SAMPLE_NAME] == "20200615-01A"
    assert rows[0][S.PEAK_AREA] == 1200.0 and rows[0][S.RT] == 2.9
    assert rows[0][S.AREA_RATIO] == "#DIV/0!"          # dirty text kept raw
    assert rows[0][S.BASELINE_SLOPE] == "0.00e+000"
    assert rows[1][S.PEAK_AREA] is None                 # N/A token -> null
    assert rows[1][S.RT] is None                        # empty -> null
    assert rows[1][S.EXPECTED_RT] is None               # '1d' is not a number
    assert rows[0]["line_no"] == len(PREAMBLE) + 2


def test_columns_in_other_order(spark, tmpdir_path):
    order = list(reversed(_header()))
    _write(tmpdir_path, "b.txt", order, [ROW1])
    r = ins.read_instrument_dir(spark, tmpdir_path).rows.first()
    assert r[S.SAMPLE_TYPE] == "Unknown" and r[S.RT] == 2.9


def test_missing_column_rejects_file(spark, tmpdir_path):
    _write(tmpdir_path, "c.txt", _header(drop=[S.RRT]), [ROW1])
    parsed = ins.read_instrument_dir(spark, tmpdir_path)
    assert parsed.rows.count() == 0
    assert "Relative Retention Time" in parsed.rejected.first()["reason"]


def test_header_positions(spark, tmpdir_path):
    d0, d1, dm = (os.path.join(tmpdir_path, x) for x in ("h0", "h1", "hm"))
    for d in (d0, d1, dm):
        os.makedirs(d)
    _write(d0, "x.txt", _header(), [ROW1], preamble=[], blank=False)      # header on line 0
    _write(d1, "x.txt", _header(), [ROW1], preamble=[], blank=True)       # header on line 1
    hdr = _header()
    mid = ["Comment"] + hdr                                                # phrase mid-line
    _write(dm, "x.txt", mid, [dict(ROW1, Comment="c")])
    assert ins.read_instrument_dir(spark, d0).rows.count() == 1
    assert ins.read_instrument_dir(spark, d0, reject_first_line_header=True).rows.count() == 0
    assert ins.read_instrument_dir(spark, d1).rows.count() == 1
    assert ins.read_instrument_dir(spark, dm).rows.count() == 1
    # the prefix rule (upload reader) does not accept a header that starts elsewhere
    assert ins.read_instrument_dir(spark, dm, match="prefix").rows.count() == 0


def test_crlf_and_no_trailing_newline(spark, tmpdir_path):
    _write(tmpdir_path, "w.txt", _header(), [ROW1, ROW1], newline="\r\n", trailing=False)
    rows = ins.read_instrument_dir(spark, tmpdir_path).rows
    assert rows.count() == 2
    assert rows.where(F.col(S.RRT) == 1.0).count() == 2     # no stray '\r' in the last field


def test_listing_rules(spark, tmpdir_path):
    for name in ("a.txt", "b.txt", "c.TXT", "d.csv", "_x.txt", ".y.txt"):
        _write(tmpdir_path, name, _header(), [ROW1])
    os.makedirs(os.path.join(tmpdir_path, "sub"))
    _write(os.path.join(tmpdir_path, "sub"), "z.txt", _header(), [ROW1])
    files = ins.read_text_files(spark, tmpdir_path).collect()
    names = sorted(os.path.basename(r["source_file"]) for r in files)
    assert names == ["a.txt", "b.txt"]


def test_empty_directory(spark, tmpdir_path):
    parsed = ins.read_instrument_dir(spark, tmpdir_path)
    assert parsed.rows.count() == 0
    assert parsed.rows.columns[:2] == ["source_file", "line_no"]


def test_strict_upload_reader(spark, tmpdir_path):
    good, bad = (os.path.join(tmpdir_path, x) for x in ("good", "bad"))
    os.makedirs(good)
    os.makedirs(bad)
    clean = {c: "1.5" for c in S.NUMERIC_COLUMNS}
    clean.update({S.SAMPLE_NAME: "20200101-01", S.SAMPLE_TYPE: "Unknown", S.PEAK_NAME: "Abamectin 1"})
    _write(good, "u.txt", _header(), [clean])
    _write(bad, "u.txt", _header(), [clean, dict(clean, **{S.PEAK_AREA: "N/A"})])
    assert ins.read_upload(spark, good).rows.count() == 1
    p = ins.read_upload(spark, bad)
    assert p.rows.count() == 0 and "non-numeric" in p.rejected.first()["reason"]


def test_header_line_number_function(spark):
    df = spark.createDataFrame([("a\nb Sample Name x\nc",), ("none",), ("Sample Name\n1",)], "t string")
    out = [r[0] for r in df.select(ins.header_line_number(F.col("t"))).collect()]
    assert out == [1, -1, 0]


def test_row_id_is_stable(spark, tmpdir_path):
    _write(tmpdir_path, "a.txt", _header(), [ROW1, ROW2])
    a = ins.with_row_id(ins.read_instrument_dir(spark, tmpdir_path).rows).select("row_id").collect()
    b = ins.with_row_id(ins.read_instrument_dir(spark, tmpdir_path).rows.repartition(3)) \
        .select("row_id").collect()
    assert sorted(r[0] for r in a) == sorted(r[0] for r in b)


def test_header_line_number_parity(spark):
    df = spark.createDataFrame([("a\nb Sample Name x\nc",), ("none",), ("Sample Name\n1",)], "t string")
    out = [r[0] for r in df.select(ins.header_line_number(F.col("t"), parity=True)).collect()]
    assert out == [0, -1, -1]
