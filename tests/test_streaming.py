"""File-stream scoring: every file processed once, outputs keyed by batch."""

import os

from pyspark.sql import functions as F

from peakscreen import schema as S
from peakscreen.streaming import batches as sb
from peakscreen.streaming.batches import ROUNDTRIP_COLUMNS as ROUNDTRIP
from peakscreen.streaming.batches import batch_writer

COLS = [S.SAMPLE_NAME, S.SAMPLE_TYPE, S.PEAK_NAME, S.PEAK_AREA, S.RT, "Score"]


def _file(path, rows):
    with open(path, "w") as f:
        f.write("Peak Name: x\n\n" + "\t".join(COLS) + "\n")
        for r in rows:
            f.write("\t".join(str(v) for v in r) + "\n")


def test_stream_scores_each_file(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    _file(os.path.join(src, "a.txt"), [("QC1", "Quality Control", "A-1", 10, 2.0, 1.0),
                                      ("U1", "Unknown", "A-1", 10, 2.0, 90.0)])
    _file(os.path.join(src, "b.txt"), [("B1", "Blank", "A-1", 10, 2.0, 90.0)])
    with open(os.path.join(src, "c.txt"), "w") as f:
        f.write("no header here\n1\t2\n")

    def score_fn(rows):
        from pyspark.sql import functions as F
        return rows.withColumn("probs", F.col("Score") / (F.col("Score") + F.lit(20.0)))

    out = os.path.join(tmpdir_path, "out")
    ck = os.path.join(tmpdir_path, "ck")
    sb.run_stream(spark, src, out, ck, score_fn, COLS, max_files_per_trigger=1)
    status = {os.path.basename(r["source_file"]): r for r in spark.read.parquet(f"{out}/control_status").collect()}
    assert status["a.txt"]["failed_controls"] == 1 and status["a.txt"]["dirty_blanks"] == 0
    assert status["b.txt"]["dirty_blanks"] == 1
    assert [r[0] for r in spark.read.parquet(f"{out}/review").select(S.SAMPLE_NAME).collect()] == ["U1"]
    assert spark.read.parquet(f"{out}/rejected_files").count() == 1
    # a restart finds nothing new and leaves the outputs as they were
    sb.run_stream(spark, src, out, ck, score_fn, COLS)
    assert spark.read.parquet(f"{out}/control_status").count() == 2


def _batch(spark, files):
    return spark.createDataFrame(files, "source_file string, content string")


def test_redelivered_and_replayed_files_count_once(spark, tmpdir_path):
    """The same content under another name or in a later batch is a repeat; a replayed batch writes what it wrote."""
    head = "\t".join(ROUNDTRIP)
    body = lambda *rows: "pre\n\n" + head + "\n" + "\n".join("\t".join(map(str, r)) for r in rows)
    one = body(("S1", "Unknown", "p-1", 5, 1.0, 90), ("S2", "Blank", "p-1", 5, 1.0, 90))
    two = body(("S3", "Quality Control", "p-1", 5, 1.0, 0.1))
    write = batch_writer(tmpdir_path, lambda rows: rows.withColumn("probs", F.col("Score") / (F.col("Score") + 20)), ROUNDTRIP,
                         numeric_columns=S.NUMERIC_COLUMNS + ["Score"])
    read = lambda name: sorted(map(str, spark.read.parquet(f"{tmpdir_path}/{name}").drop("batch").collect()))
    write(_batch(spark, [("a.txt", one), ("copy.txt", one)]), 0)
    write(_batch(spark, [("b.txt", two), ("late.txt", one)]), 1)
    state = {n: read(n) for n in ("review", "failed_controls", "dirty_blanks", "profit", "ledger", "repeats")}
    assert [len(state[n]) for n in ("review", "failed_controls", "dirty_blanks", "ledger", "repeats")] == [1, 1, 1, 2, 2]
    profit = {r.batch_id: (r.batch_cents, r.running_cents) for r in spark.read.parquet(f"{tmpdir_path}/profit").collect()}
    assert profit == {0: (50, 50), 1: (-10000, -9950)}
    write(_batch(spark, [("b.txt", two), ("late.txt", one)]), 1)
    write(_batch(spark, [("a.txt", one), ("copy.txt", one)]), 0)
    assert state == {n: read(n) for n in state}


def test_a_batch_leaves_one_ledger_file_and_reads_its_own_digests_only(spark, tmpdir_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = os.path.join(tmpdir_path, "out")
        write = batch_writer(out, lambda rows: rows.withColumn("probs", F.col("Score") / (F.col("Score") + F.lit(20.0))), COLS)
        text = lambda n: "Peak Name: x\n\n" + "\t".join(COLS) + f"\nB{n}\tBlank\tA-1\t{n}\t2.0\t90.0\n"
        files = lambda names: spark.createDataFrame([(f"{n}.txt", text(n)) for n in names], "source_file string, content string")
        write(files(range(12)), 0)
        for name in ("ledger", "control_status"):
            assert len([f for f in os.listdir(f"{out}/{name}/batch=0") if f.startswith("part-")]) == 1
        fresh, counted, repeats = sb.fresh_files(files([3, 20]), out, 1)
        assert [r["source_file"] for r in counted.collect()] == ["20.txt"] and [r["source_file"] for r in repeats.collect()] == ["3.txt"]
        assert "LeftSemi" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
