"""Token-id files with a shared zstandard dictionary and an offset index.

A store is a folder in any file system that Spark can write:

- ``segments`` (Parquet): a row holds up to ``SEGMENT_DOCS`` documents or about
  ``SEGMENT_BYTES`` of compressed payload. ``payload`` is the documents' zstandard frames
  end to end, ``offsets`` the frames' bounds (one more than documents), ``doc_ids`` and ``n_tokens`` the
  documents, ``dict_sha256`` the dictionary they need. Rows are ordered by ``(part,
  seg)`` in ascending doc_id. A document is its ids as little-endian unsigned 32-bit
  integers, end id included, compressed on its own, so one frame is read without its neighbours.
- ``dictionary`` (Parquet): one row ``dict_sha256, dictionary``.

The dictionary is trained on the whole id arrays of at most ``DICT_DOCS`` documents
(those with the smallest hash of their id); too few or too uniform samples give
no dictionary (empty bytes), which the format allows.

Defined cases: a null text is empty and gives the end id alone; null ids come first;
rows with equal ids are ordered by text hash; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakscreen.llm.common import map_arrow, staged
from peakscreen.llm.encoding import encoder
from peakscreen.session import ship_package

END_ID = 0
DICT_BYTES = 112_640
DICT_DOCS = 1000
SEGMENT_BYTES = 1 << 22
SEGMENT_DOCS = 4096
LEVEL = 3

SEGMENT_SCHEMA = ("part int, seg int, doc_ids array<bigint>, n_tokens array<int>, "
                  "offsets array<bigint>, dict_sha256 string, payload binary")


def encoded(batch: pa.Array, tokenizer_json: str, control_ids: bool = False) -> list[bytes]:
    """Each text's ids with the end id, as little-endian bytes."""
    flat, cuts = encoder(tokenizer_json, control_ids).batch(batch)
    raw, end = flat.astype("<u4").tobytes(), np.array([END_ID], dtype="<u4").tobytes()
    return [raw[4 * a:4 * b] + end for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def train_dictionary(docs: DataFrame, tokenizer_json: str, limit: int = DICT_DOCS, control_ids: bool = False) -> bytes:
    sample = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(limit)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(encoded(b.column("text"), tokenizer_json, control_ids), pa.binary())], names=["ids"])

    samples = [bytes(r["ids"]) for r in map_arrow(sample, batch, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, sorted(samples)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _context(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_store(docs: DataFrame, path: str, tokenizer_json: str, control_ids: bool = False) -> str:
    """Write ``docs(doc_id, text)`` as a store at ``path``; returns the dictionary's hash.

    ``control_ids``: control strings in a text get their special ids (:class:`~peakscreen.llm.encoding.Encoder`).
    """
    spark = docs.sparkSession
    ship_package(spark)
    dictionary = train_dictionary(docs, tokenizer_json, control_ids=control_ids)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "dict_sha256 string, dictionary binary") \
        .coalesce(1).write.parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg = TaskContext.get().partitionId(), 0
        compress = zstandard.ZstdCompressor(level=LEVEL, **_context(dictionary)).compress
        ids, counts, frames, held = [], [], [], 0

        def segment():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()),
                 pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(counts)], pa.list_(pa.int32())),
                 pa.array([offsets], pa.list_(pa.int64())), pa.array([sha]),
                 pa.array([b"".join(frames)], pa.binary())],
                names=["part", "seg", "doc_ids", "n_tokens", "offsets", "dict_sha256", "payload"])

        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), encoded(b.column("text"), tokenizer_json, control_ids)):
                frame = compress(raw)
                ids.append(doc_id)
                counts.append(len(raw) // 4)
                frames.append(frame)
                held += len(frame)
                if held >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                    yield segment()
                    seg, held = seg + 1, 0
                    ids.clear(), counts.clear(), frames.clear()
        if ids:
            yield segment()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(pack, SEGMENT_SCHEMA).write.parquet(f"{path}/segments")
    return sha


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    """The store's dictionary (one row of at most ``DICT_BYTES``), checked against its hash."""
    sha, data = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(data)
    if hashlib.sha256(data).hexdigest() != sha:
        raise ValueError(f"the dictionary of {path} is damaged")
    return sha, data


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``: the number of ids in all segments before.

    Sums within each part, then over the parts (one row per written part).
    """
    segs = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)
    sizes = segs.select("part", "seg", total.alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(
        Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part"))
    inside = F.coalesce(F.sum("n").over(
        Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "seg", inside.alias("_in")).join(parts, "part").select(
        "part", "seg", (F.col("_in") + F.col("_part")).alias("start"))
    # Written first: the planner then sees how small it is and leaves the payloads in place.
    return segs.join(staged(starts, "token-starts"), ["part", "seg"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the stored frames."""
    sha, dictionary = read_dictionary(spark, path)

    def unpack(b: pa.RecordBatch) -> pa.RecordBatch:
        expand = zstandard.ZstdDecompressor(**_context(dictionary)).decompress
        rows = []
        for r in b.to_pylist():
            if r["dict_sha256"] != sha:
                raise ValueError("a segment needs another dictionary")
            at = r["start"]
            for i, (doc_id, n) in enumerate(zip(r["doc_ids"], r["n_tokens"])):
                raw = expand(r["payload"][r["offsets"][i]:r["offsets"][i + 1]])
                if len(raw) != 4 * n:
                    raise ValueError(f"document {doc_id} is damaged")
                rows.append((doc_id, at, n, zlib.crc32(raw)))
                at += n
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(segments(spark, path), unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (several, if the id repeats), through the offset index alone."""
    sha, dictionary = read_dictionary(spark, path)
    segs = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    at = F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.element_at("doc_ids", i) == doc_id)
    frames = segs.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))) \
        .select("part", "seg", "offsets", "payload", F.explode(at).alias("i")).select(
            "part", "seg", "i", F.expr("substring(payload, int(offsets[i - 1]) + 1, int(offsets[i] - offsets[i - 1]))").alias("f"))
    expand = zstandard.ZstdDecompressor(**_context(dictionary)).decompress
    return [np.frombuffer(expand(bytes(r["f"])), dtype="<u4") for r in frames.orderBy("part", "seg", "i").collect()]
