"""Files split by byte offset give the rows of whole-file reading."""

import os

from peakscreen import schema as S
from peakscreen.sources import instrument as ins


def _write(folder, name, lines, end="\n"):
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(end.join(lines) + end)


def _rows(parsed):
    return sorted(map(tuple, parsed.rows.collect()), key=str), sorted((r.source_file.rsplit("/", 1)[1], r.reason) for r in parsed.rejected.collect())


def test_one_file_over_many_tasks(spark, tmpdir_path):
    head = "\t".join(S.PEAK_COLUMNS)
    line = lambda i: "\t".join([f'"S {i}"', "Unknown", "Imazalil-1", *(str(i + k) if (i + k) % 9 else "#DIV/0!" for k in range(17))])
    _write(tmpdir_path, "big.txt", ["Peak Name: x", "", head, *[line(i) if i % 50 else "" for i in range(4000)]])
    _write(tmpdir_path, "dos.txt", ["preamble", head, *map(line, range(300))], "\r\n")
    _write(tmpdir_path, "none.txt", ["no header here", *map(line, range(200))])
    _write(tmpdir_path, "short.txt", ["Sample Name\tother", "a\tb"])
    _write(tmpdir_path, "first.txt", [head, line(1), "Sample Name again", line(2)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = _rows(ins.read_instrument_dir(spark, tmpdir_path))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        split = ins.parse_split_files(spark, tmpdir_path)
        assert ins.read_numbered_lines(spark, tmpdir_path).select("source_file").rdd.getNumPartitions() >= 1
        assert spark.read.option("lineSep", "\n").text(tmpdir_path).rdd.getNumPartitions() > 10
        assert _rows(split) == whole
        strict = [c for c in S.NUMERIC_COLUMNS]
        assert _rows(ins.parse_split_files(spark, tmpdir_path, strict_numeric=strict)) == \
            _rows(ins.read_instrument_dir(spark, tmpdir_path, strict_numeric=strict))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_file(spark, tmpdir_path):
    _write(tmpdir_path, "blank.txt", [""])
    rows, rejected = _rows(ins.parse_split_files(spark, tmpdir_path))
    assert rows == [] and [n for n, _ in rejected] == ["blank.txt"]
