"""Chat formatting by token-level assembly.

Every turn is encoded on its own (role and text), before any shuffle; turns of a
conversation are then spliced together with reserved ids beyond the vocabulary::

    <turn> role <text> text <end>   per turn

The loss mask covers the text ids of ``loss_role`` turns and comes from a prefix
sum over +1 / -1 marks at segment bounds. Since control strings occur only as
reserved ids, nothing in a text can open or close a turn; strings in a text that
look like control strings (of this or of other common templates) are escaped
reversibly all the same, so that the rendered text is unambiguous too: an escape
character is put behind the first character, and one more is added where some
are there already.

Conversations come out as chunks of at most ``CHUNK`` ids that end at turn bounds
where a turn fits (a longer turn is a chunk of its own), in order, so a conversation of any length
is streamed and never held. :func:`read_back` decodes the chunks.

Defined cases: a null text or role is empty; null conversation ids are one conversation;
null turns come first; rows with equal turn numbers are ordered by role, then encoded text; equal
rows are separate turns; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakscreen.llm.common import map_arrow
from peakscreen.llm.encoding import encoder
from peakscreen.session import ship_package

#: Reserved marks in template order; their ids follow the vocabulary.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and of common public templates.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>",
           "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
           "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
           "<start_of_turn>", "<end_of_turn>")
ESCAPE = "\\"
CHUNK = 1 << 16

_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])({re.escape(ESCAPE)}*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[]){re.escape(ESCAPE)}({re.escape(ESCAPE)}*)(?={_TAILS})")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[1] + ESCAPE + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2], text)


def vocabulary_size(tokenizer_json: str) -> int:
    return encoder(tokenizer_json).tokenizer.get_vocab_size(with_added_tokens=True)


def encode_turns(turns: DataFrame, tokenizer_json: str) -> DataFrame:
    """``conv_id, turn, role, role_ids, text_ids`` with ids as little-endian unsigned 32 bits."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer_json)

        def packed(column: str) -> pa.Array:
            flat, cuts = enc.batch(pa.array([escape(x or "") for x in b.column(column).to_pylist()], pa.string()))
            raw = flat.astype("<u4").tobytes()
            return pa.array([raw[4 * i:4 * j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())

        return pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("turn"), b.column("role"), packed("role"), packed("text")],
            names=["conv_id", "turn", "role", "role_ids", "text_ids"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), "text")
    return map_arrow(rows, batch, "conv_id long, turn long, role string, role_ids binary, text_ids binary")


def assemble(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Splice (ids, in loss) segments: the ids, and the mask as a prefix sum of bound marks."""
    sizes = np.array([len(p) for p, _ in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    marks = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
    on = np.array([m for _, m in parts], dtype=np.int64)
    np.add.at(marks, ends - sizes, on)
    np.add.at(marks, ends, -on)
    return np.concatenate([p for p, _ in parts]), np.cumsum(marks)[:-1].astype(np.int8)


CHUNK_SCHEMA = "conv_id long, chunk int, start long, n_turns int, input_ids array<int>, loss_mask array<tinyint>"


def format_conversations(turns: DataFrame, tokenizer_json: str, loss_role: str = "assistant") -> DataFrame:
    """Chunks ``conv_id, chunk, start, n_turns, input_ids, loss_mask`` of the formatted conversations.

    One shuffle, of the encoded turns by conversation; the chunks of a
    conversation follow one another within a partition.
    """
    ship_package(turns.sparkSession)
    base = vocabulary_size(tokenizer_json)
    turn, text, end = (np.array([base + i], dtype=np.uint32) for i in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, chunk, start = None, 0, 0
        parts: list[tuple[np.ndarray, int]] = []
        held = n_turns = 0

        def emit():
            nonlocal chunk, start, held, n_turns
            ids, mask = assemble(parts)
            row = pa.RecordBatch.from_arrays(
                [pa.array([open_conv[0]], pa.int64()), pa.array([chunk], pa.int32()),
                 pa.array([start], pa.int64()), pa.array([n_turns], pa.int32()),
                 pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8()))],
                names=["conv_id", "chunk", "start", "n_turns", "input_ids", "loss_mask"])
            chunk, start, held, n_turns = chunk + 1, start + len(ids), 0, 0
            parts.clear()
            return row

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("conv_id", "role", "role_ids", "text_ids")]
            for conv, role, role_ids, text_ids in zip(*cols):
                size = (len(role_ids) + len(text_ids)) // 4 + 3
                if parts and ((conv,) != open_conv or held + size > CHUNK):
                    yield emit()
                if (conv,) != open_conv:
                    open_conv, chunk, start = (conv,), 0, 0
                parts += [(turn, 0), (np.frombuffer(role_ids, dtype="<u4"), 0), (text, 0),
                          (np.frombuffer(text_ids, dtype="<u4"), int(role == loss_role)), (end, 0)]
                held, n_turns = held + size, n_turns + 1
        if parts:
            yield emit()

    encoded = encode_turns(turns, tokenizer_json)
    return (encoded.repartition("conv_id")
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text_ids")
            .mapInArrow(run, CHUNK_SCHEMA))


def read_back(chunks: DataFrame, tokenizer_json: str) -> DataFrame:
    """Decode formatted chunks (in the order they were made) to digests per conversation."""
    ship_package(chunks.sparkSession)
    base = vocabulary_size(tokenizer_json)
    marks = {base: TURN, base + 1: TEXT, base + 2: END}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(tokenizer_json).tokenizer.decode_batch
        done: list[tuple] = []
        now = None

        def fresh(conv):
            return {"conv": conv, "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0}

        def flush():
            cols = list(zip(*done))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        def close():
            done.append((now["conv"], now["turns"], now["sha"].hexdigest(), now["loss"],
                         now["loss_sha"].hexdigest(), now["chars"]))

        for b in batches:
            ids_column, mask_column = b.column("input_ids"), b.column("loss_mask")
            for r in range(b.num_rows):
                conv, chunk = b.column("conv_id")[r].as_py(), b.column("chunk")[r].as_py()
                if chunk == 0:
                    if now:
                        close()
                    now = fresh(conv)
                ids = ids_column[r].values.to_numpy()
                mask = mask_column[r].values.to_numpy()
                at = np.flatnonzero(ids >= base)
                # Segments between reserved ids, then runs under the mask.
                segments = [ids[i + 1:j].tolist() for i, j in zip(at[:-1], at[1:])]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                masked = [ids[i:j].tolist() for i, j in zip(edge[::2], edge[1::2])]
                texts = decode(segments + masked, skip_special_tokens=False)
                for kind, segment in zip(ids[at].tolist(), texts):
                    now["chars"] += len(marks[kind]) + len(segment)
                    if kind == base:
                        now["turns"] += 1
                        now["sha"].update(unescape(segment).encode() + b"\n")
                    elif kind == base + 1:
                        now["sha"].update(unescape(segment).encode() + b"\n")
                now["chars"] += len(END)
                for run_text in texts[len(segments):]:
                    plain = unescape(run_text)
                    now["loss"] += len(plain)
                    now["loss_sha"].update(plain.encode())
            if len(done) >= 1000:
                yield flush()
        if now:
            close()
        if done:
            yield flush()

    return chunks.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                  "loss_sha256 string, formatted_chars long")
