"""Score arriving export files with Structured Streaming.

A file is a complete unit (a batch of injections), so no watermark or state is
needed: each micro-batch parses its new files, scores them, derives decisions
and writes three lists plus one status row per file. Output partitions are
keyed by the micro-batch id and overwritten on replay, so a restarted query
(after an executor or driver loss) rewrites the same result instead of
duplicating it.

A ledger keeps the digest of every file's content with the batch that counted it: the same content delivered
again, under another name or in another batch, is listed as a repeat and counted once. The
running profit of a batch continues from the batches before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakscreen import schema as S
from peakscreen.operators import batch_qc as qc
from peakscreen.session import ensure_checkpoint_dir
from peakscreen.sources.instrument import parse_files


def read_file_stream(spark: SparkSession, path: str, glob: str = "*.txt",
                     max_files_per_trigger: int | None = None, recursive: bool = False) -> DataFrame:
    """New export files as (source_file, content) records; sub-folders only if ``recursive``."""
    r = (spark.readStream.format("text").option("wholetext", "true")
         .option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = r.load(path)
    return df.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("content"))


def _written(spark: SparkSession, out_dir: str, name: str, schema: str, batch_id: int) -> DataFrame:
    """Rows that earlier batches wrote to an output (a replay does not see its own)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{name}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out_dir}/{name}").where(F.col("batch_id") < batch_id)


LEDGER = "digest string, source_file string, batch_id long"
#: Outputs with at most one row per file of the batch, known only after a shuffle.
PER_FILE = ("control_status", "profit", "ledger")
PROFIT = "batch_cents long, running_cents long, batch_id long"


def fresh_files(batch: DataFrame, out_dir: str, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files whose content no earlier batch counted, their ledger rows, repeats); of equal files in a batch the first name counts."""
    marked = batch.withColumn("digest", F.sha2("content", 256))
    first = marked.groupBy("digest").agg(F.min("source_file").alias("_first"))
    # Of the ledger, only digests of this batch leave the tasks that read it.
    seen = _written(batch.sparkSession, out_dir, "ledger", LEDGER, batch_id).select("digest") \
        .join(F.broadcast(first.select("digest")), "digest", "left_semi").distinct()
    counted = first.join(seen, "digest", "left_anti").select("digest", F.col("_first").alias("source_file"))
    fresh = marked.join(counted, ["digest", "source_file"], "left_semi").drop("digest")
    repeats = marked.join(counted, ["digest", "source_file"], "left_anti").select("digest", "source_file")
    return fresh, counted, repeats


def batch_writer(out_dir: str, score_fn: Callable[[DataFrame], DataFrame],
                 columns: Sequence[str], threshold: float = 0.4,
                 rt: str = S.RT, sample_type: str = S.SAMPLE_TYPE,
                 list_cols: Sequence[str] = (S.SAMPLE_NAME, S.PEAK_NAME, S.PEAK_AREA, "source_file"),
                 numeric_columns: Sequence[str] = S.NUMERIC_COLUMNS, area: str = S.PEAK_AREA):
    """foreachBatch function: new files -> parse -> score -> decide -> write lists, status, profit and ledger."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh, counted, repeats = fresh_files(batch, out_dir, batch_id)
        parsed = parse_files(fresh, columns, numeric_columns=numeric_columns)
        decided = qc.add_decisions(score_fn(parsed.rows), score="probs", rt=rt,
                                   sample_type=sample_type, threshold=threshold)
        decided = decided.persist()
        failed, dirty = qc.control_lists(decided, list_cols)
        review = qc.review_list(decided, [*list_cols[:2], *(c for c in list_cols[2:] if c == "source_file")])
        status = qc.control_status(decided, ["source_file"])
        before = _written(spark, out_dir, "profit", PROFIT, batch_id).agg(F.coalesce(F.sum("batch_cents"), F.lit(0)).alias("b"))
        own = qc.add_profit(decided, area).agg(F.coalesce(F.sum("profit_cents"), F.lit(0)).cast("long").alias("batch_cents"))
        profit = own.crossJoin(before).select("batch_cents", (F.col("batch_cents") + F.col("b")).cast("long").alias("running_cents"))  # one row each
        # The ledger comes last: a batch that failed before it is processed again as a whole.
        for name, df in [("failed_controls", failed), ("dirty_blanks", dirty),
                         ("review", review), ("control_status", status), ("profit", profit), ("repeats", repeats),
                         ("rejected_files", parsed.rejected), ("ledger", counted)]:
            rows = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
            # A row per file at most: one task writes one file, which later batches read.
            (rows.coalesce(1) if name in PER_FILE else rows).write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={batch_id}")
        decided.unpersist()
    return write


def run_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
               score_fn: Callable[[DataFrame], DataFrame], columns: Sequence[str] = S.PEAK_COLUMNS,
               max_files_per_trigger: int | None = None, recursive: bool = False, **kw) -> None:
    """Process every file available now, then stop (``availableNow`` trigger)."""
    src = read_file_stream(spark, in_dir, max_files_per_trigger=max_files_per_trigger, recursive=recursive)
    q = (src.writeStream.foreachBatch(batch_writer(out_dir, score_fn, columns, **kw))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


# ---------------------------------------------------------------------------
# Round trip on the driver's events table (registered query ``stream_batches``)
# ---------------------------------------------------------------------------

# Header of the generated export files.
ROUNDTRIP_COLUMNS = [S.SAMPLE_NAME, S.SAMPLE_TYPE, S.PEAK_NAME, S.PEAK_AREA, S.RT, "Score"]
#: Event ids per export file: a row's file follows from the row alone, at any data size.
ROWS_PER_FILE = 20000


def write_event_exports(spark: SparkSession, sf_dir: str, out_dir: str) -> None:
    """Write events as export files: one file per (day, bucket), preamble + header first.

    Events of a day are spread over files of at most ``ROWS_PER_FILE`` ids, so no
    file (and no task) holds a hot day or a hot user whole; the header row
    sorts first within its file.
    """
    from peakscreen.plans.views import EVENT_OTHER_TYPE, EVENT_SAMPLE_TYPE, load
    ev = load(spark, sf_dir, "events")
    st = F.coalesce(F.create_map(*[F.lit(x) for kv in EVENT_SAMPLE_TYPE.items() for x in kv])[
        F.col("event_type")], F.lit(EVENT_OTHER_TYPE))
    k = F.get_json_object("props", "$.k")
    rows = ev.select(
        F.date_format("ts", "yyyyMMdd").alias("day"),
        F.floor(F.col("event_id") / F.lit(ROWS_PER_FILE)).cast("int").alias("bucket"),
        F.col("event_id").alias("_ord"),
        F.concat_ws("\t", F.concat(F.lit("S"), F.col("user_id").cast("string")), st,
                    F.concat(F.col("event_type"), F.lit("-1")), F.col("user_id").cast("string"),
                    k, F.col("value").cast("string")).alias("value"))
    write_exports(rows, ROUNDTRIP_COLUMNS, out_dir)


def write_exports(rows: DataFrame, columns: Sequence[str], out_dir: str) -> None:
    """Write ``day, bucket, _ord, value`` lines as one export file per (day, bucket): preamble, header, lines in order."""
    keys = rows.select("day", "bucket").distinct()
    head = keys.select("day", "bucket", F.lit(-2).cast("long").alias("_ord"),
                       F.concat(F.lit("Peak Name: events\nExported "), F.col("day"),
                                F.lit("\n")).alias("value"))
    header = keys.select("day", "bucket", F.lit(-1).cast("long").alias("_ord"), F.lit("\t".join(columns)).alias("value"))
    allr = head.unionByName(header).unionByName(rows)
    (allr.repartition("day", "bucket").sortWithinPartitions("day", "bucket", "_ord")
     .select("day", "bucket", "value")
     .write.mode("overwrite").partitionBy("day", "bucket").text(out_dir))


def stream_events_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write events as exports, stream them through scoring, return per-file control status."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    in_dir, out_dir, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    write_event_exports(spark, sf_dir, in_dir)

    def score_fn(rows: DataFrame) -> DataFrame:
        v = F.col("Score")
        return rows.withColumn("probs", v / (v + F.lit(20.0)))

    columns_typed = ROUNDTRIP_COLUMNS
    run_stream(spark, in_dir, out_dir, ckpt, score_fn, columns_typed, max_files_per_trigger=16, recursive=True,
               numeric_columns=S.NUMERIC_COLUMNS + ["Score"])
    status = spark.read.parquet(f"{out_dir}/control_status")
    # Key each file by the (day, bucket) it holds; paths and batch numbers vary per run.
    return status.select(
        F.regexp_extract("source_file", r"day=([0-9]+)", 1).alias("day"),
        F.regexp_extract("source_file", r"bucket=([0-9]+)", 1).cast("int").alias("bucket"),
        "failed_controls", "dirty_blanks", "controls_pass", "blanks_pass")
