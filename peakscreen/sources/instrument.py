"""Instrument export reader.

An export is a text file: a free-form preamble, a blank line, a header line
containing ``Sample Name`` and tab-separated data lines. Each file is read as
one record (``wholetext``), the header is located with array functions on that
record and the data lines are exploded and projected *by header name*. Nothing
is shuffled: a file is a self-contained unit, so a directory of any size is one
parallel scan, and files without a usable header are reported in a side
DataFrame instead of being printed and dropped. Files larger than a task are read by
:func:`parse_split_files`, split by byte offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakscreen import schema as S
from peakscreen.functions.cleaning import coerce_double, null_tokens

LINE_SPLIT = r"\r?\n"


class ParsedFiles(NamedTuple):
    rows: DataFrame       # one row per data line, typed by ``schema.peak_schema``
    rejected: DataFrame   # (source_file, reason)


def read_text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Whole files as (source_file, content).

    Non-recursive, case-sensitive ``*.txt`` match; Hadoop listing skips names
    starting with ``_`` or ``.``.
    """
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return df.select(F.col("_metadata.file_path").alias("source_file"),
                     F.col("value").alias("content"))


def header_index(lines: Column, phrase: str = S.HEADER_PHRASE,
                 match: str = "contains") -> Column:
    """1-based position of the first line holding ``phrase``; 0 when absent."""
    if match == "contains":
        test = lambda l: F.contains(l, F.lit(phrase))
    elif match == "prefix":
        test = lambda l: F.startswith(l, F.lit(phrase))
    else:
        raise ValueError(f"unknown header match mode {match!r}")
    return F.array_position(F.transform(lines, test), F.lit(True)).cast("int")


def header_line_number(content: Column, phrase: str = S.HEADER_PHRASE,
                       match: str = "contains", parity: bool = False) -> Column:
    """0-based line number of the header line, or -1 when there is none.

    ``parity=True`` returns the historical value, line number minus one (so a
    header on line 0 and a missing header both give -1).
    """
    pos = header_index(F.split(content, LINE_SPLIT), phrase, match)
    if parity:
        return F.when(pos == 0, F.lit(-1)).otherwise(pos - 2)
    return pos - 1


def parse_files(files: DataFrame, columns: Sequence[str] = S.PEAK_COLUMNS,
                phrase: str = S.HEADER_PHRASE, match: str = "contains",
                delimiter: str = "\t", strict_numeric: Sequence[str] | None = None,
                reject_first_line_header: bool = False,
                typed: bool = True,
                numeric_columns: Sequence[str] = S.NUMERIC_COLUMNS) -> ParsedFiles:
    """Parse (source_file, content) records into a projected peak table.

    * ``match='contains'`` finds the phrase anywhere in a line (directory
      reader); ``'prefix'`` requires the line to start with it (upload reader).
    * ``reject_first_line_header=True`` reproduces the historical rule that a
      header on the very first line is not found.
    * ``strict_numeric``: columns that must all be numbers; one bad value
      rejects the whole file (upload reader).
    * A file missing one of ``columns`` is rejected with the missing names.
    * ``numeric_columns`` are coerced to double (guarded); others stay text.
    """
    cols = list(columns)
    lines = F.split(F.col("content"), LINE_SPLIT)
    staged = files.select(
        "source_file", lines.alias("_lines"),
    ).withColumn("_h", header_index(F.col("_lines"), phrase, match))
    hdr = F.split(F.element_at("_lines", F.greatest(F.col("_h"), F.lit(1))), delimiter, -1)
    staged = staged.withColumn("_hdr", F.when(F.col("_h") > 0, hdr))
    staged = staged.withColumn(
        "_missing", F.array_except(F.array(*[F.lit(c) for c in cols]), F.col("_hdr")))
    # Positions of the wanted columns inside this file's header (1-based).
    pos_cols = [F.array_position("_hdr", F.lit(c)).cast("int").alias(f"_p{i}")
                for i, c in enumerate(cols)]
    staged = staged.select("*", *pos_cols)
    data_lines = F.slice("_lines", F.col("_h") + 1, F.greatest(F.size("_lines") - F.col("_h"), F.lit(1)))

    reason = (F.when(F.col("_h") == 0, F.lit(f'no header line containing "{phrase}"'))
              .when(F.lit(reject_first_line_header) & (F.col("_h") == 1),
                    F.lit("header on the first line"))
              .when(F.size("_missing") > 0,
                    F.concat(F.lit("missing columns: "), F.array_join("_missing", ", "))))
    staged = staged.withColumn("_reason", reason)

    rejected = staged.where(F.col("_reason").isNotNull()).select(
        "source_file", F.col("_reason").alias("reason"))

    ok = staged.where(F.col("_reason").isNull())
    exploded = ok.select(
        "source_file", *[f"_p{i}" for i in range(len(cols))],
        F.posexplode(data_lines).alias("_pos", "_line"),
        F.col("_h"),
    ).where(F.trim("_line") != "")
    rows, rejected = _typed_rows(exploded.withColumn("_no", (F.col("_h") + F.col("_pos")).cast("int")), rejected, cols, delimiter,
                                 strict_numeric, typed, numeric_columns)
    return ParsedFiles(rows, rejected)


def _typed_rows(data: DataFrame, rejected: DataFrame, cols: Sequence[str], delimiter: str, strict_numeric: Sequence[str] | None,
                typed: bool, numeric_columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Data lines (``source_file, _no, _line`` and the columns' positions ``_p0`` ...) as typed rows."""
    fields = F.split("_line", delimiter, -1)
    out = [F.col("source_file"), F.col("_no").alias("line_no")]
    for i, c in enumerate(cols):
        raw = F.try_element_at(fields, F.col(f"_p{i}"))
        raw = null_tokens(raw)
        if typed and c in numeric_columns:
            val = coerce_double(raw)
        else:
            val = raw
        out.append(val.alias(c))
    if strict_numeric:
        # One flag per line, in generated code; the bad-file list is partially
        # aggregated (about one row per file) and removed with an anti join.
        idx = {c: i for i, c in enumerate(cols)}
        bad = None
        for c in strict_numeric:
            v = F.trim(F.try_element_at(fields, F.col(f"_p{idx[c]}")))
            b = F.coalesce(~v.rlike(S.NUMERIC_PATTERN) & (v != ""), F.lit(True))   # a blank is a missing value
            bad = b if bad is None else bad | b
        out.append(bad.alias("_bad"))
    rows = data.select(*out)
    if strict_numeric:
        bad_files = rows.where(F.col("_bad")).select("source_file").distinct()
        rejected = rejected.unionByName(bad_files.select(
            "source_file", F.lit("non-numeric value in a numeric column").alias("reason")))
        rows = rows.join(bad_files, "source_file", "left_anti").drop("_bad")
    return rows, rejected


def read_numbered_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """``source_file, line_no, line`` of files that are split by byte offset: one file may be many tasks.

    A split's lines are numbered from its first; the lines of earlier splits of the file are added from a
    table with one row per split. Splits and the order within them follow from the files alone.
    """
    read = spark.read.option("lineSep", "\n").text(path, pathGlobFilter=glob)
    lines = read.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_split"),
                        F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r$", "").alias("line"))
    before = Window.partitionBy("source_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("source_file", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")) \
        .select("source_file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(splits, ["source_file", "_split"]).select(
        "source_file", (F.col("_at") - F.col("_first") + F.col("_before")).cast("int").alias("line_no"), "line")


def parse_split_files(spark: SparkSession, path: str, columns: Sequence[str] = S.PEAK_COLUMNS, glob: str = "*.txt",
                      phrase: str = S.HEADER_PHRASE, match: str = "contains", delimiter: str = "\t",
                      strict_numeric: Sequence[str] | None = None, typed: bool = True,
                      numeric_columns: Sequence[str] = S.NUMERIC_COLUMNS) -> ParsedFiles:
    """As :func:`parse_files` for files of any size (S3, S6): the header of each file, one row, goes to all its splits.

    The files are scanned three times (split sizes, headers, rows) and no line is shuffled unless the
    planner finds the table of splits or headers too large to broadcast.
    """
    cols = list(columns)
    lines = read_numbered_lines(spark, path, glob)
    test = F.contains("line", F.lit(phrase)) if match == "contains" else F.startswith("line", F.lit(phrase))
    heads = lines.groupBy("source_file").agg(F.min_by("line", F.when(test, F.col("line_no"))).alias("_head"),
                                             F.min(F.when(test, F.col("line_no"))).alias("_head_no"))
    names = F.split("_head", delimiter, -1)
    heads = heads.select("source_file", "_head_no", F.array_except(F.array(*[F.lit(c) for c in cols]), names).alias("_missing"),
                         *[F.array_position(names, F.lit(c)).cast("int").alias(f"_p{i}") for i, c in enumerate(cols)])
    reason = F.when(F.col("_head_no").isNull(), F.lit(f'no header line containing "{phrase}"')).when(
        F.size("_missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("_missing", ", ")))
    heads = heads.withColumn("_reason", reason)
    rejected = heads.where(F.col("_reason").isNotNull()).select("source_file", F.col("_reason").alias("reason"))
    good = heads.where(F.col("_reason").isNull()).drop("_missing", "_reason")
    data = lines.join(good, "source_file").where((F.col("line_no") > F.col("_head_no")) & (F.trim("line") != "")) \
        .withColumnsRenamed({"line_no": "_no", "line": "_line"})
    return ParsedFiles(*_typed_rows(data, rejected, cols, delimiter, strict_numeric, typed, numeric_columns))


def read_instrument_dir(spark: SparkSession, path: str,
                        columns: Sequence[str] = S.PEAK_COLUMNS, glob: str = "*.txt",
                        **kw) -> ParsedFiles:
    """List + parse a directory of exports in one scan (S1 + S3 + S6).

    An empty directory yields an empty, correctly typed table.
    """
    try:
        files = read_text_files(spark, path, glob)
    except Exception as e:  # noqa: BLE001 - Spark raises on an empty or absent directory
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e) \
                and "does not exist" not in str(e):
            raise
        files = spark.createDataFrame([], "source_file string, content string")
    return parse_files(files, columns, **kw)


def read_upload(spark: SparkSession, path: str, columns: Sequence[str] = S.PEAK_COLUMNS,
                glob: str = "*") -> ParsedFiles:
    """Upload-form reader (S4 + S5): header must start the line, numbers strict."""
    strict = [c for c in S.NUMERIC_COLUMNS if c in columns]
    return read_instrument_dir(spark, path, columns, glob=glob, match="prefix",
                               strict_numeric=strict)


def union_batches(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; columns missing in a frame become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_row_id(df: DataFrame, file_col: str = "source_file", line_col: str = "line_no",
                out: str = "row_id") -> DataFrame:
    """Stable row id from (file, line): identical across runs and partitionings."""
    return df.withColumn(out, F.xxhash64(F.col(file_col), F.col(line_col)))


EMPTY_ROWS_SCHEMA: T.StructType = S.peak_schema()
