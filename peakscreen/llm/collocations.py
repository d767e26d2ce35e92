"""Phrase collocations counted on a prefix-free parse.

1. Texts are lower-cased (A-Z), cut into pieces and words. A window of ``OVERLAP`` words whose content hash is
   divisible by ``PERIOD`` ends one chunk and begins the next, so chunks overlap by that window and the
   same passage gives the same chunks wherever it stands. Distinct chunks form the dictionary; their
   numbers are the parse frequencies.
2. n-grams are counted inside the distinct chunks and weighted by the chunk's frequency. An n-gram belongs to
   the chunk in which it starts outside the trailing window (in the last chunk of a piece: anywhere), so
   that every occurrence counts once; the window is long enough for the longest phrase to end inside.
3. Counting goes by length: words (with the parse), then pairs of words that are frequent, then longer phrases whose pairs are
   frequent. A task's pairs travel packed by ranges of first words, and a range is added up as a whole. What is frequent reaches the tasks as a Bloom filter of bounded size. Phrases
   are first counted by two hashes in a table of bounded size per task; those with a bucket that stays below the
   threshold over all tasks are not counted further. Either device, when too small for the data, lets more phrases
   through to the exact counts and loses none.
4. Candidates (2 to ``LONGEST`` words, at least ``LEAST`` occurrences) take the score of their weakest cut, those that
   live inside a longer one are dropped, and each language reports its first ``TOP``.

Word pairs travel as two 64-bit word hashes; should two words share a hash, the words are hashed anew with
another seed, so counts are exact. Sums are longs, products decimals of 38 digits; a product beyond that fails.

Defined cases: a null text has no words; a null language is ``und``; equal rows count as often as they
occur; texts may be of any length (a task holds one text's words as numbers); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakscreen.llm.common import discard, staged, staged_at
from peakscreen.session import ship_package

LONGEST, LEAST, TOP, NESTED_PERCENT = 5, 100, 2000, 100
OVERLAP = LONGEST - 1
PERIOD = 12
#: Words that a task gathers before it counts or parses them.
GATHER = 1 << 21
#: Bits of the filter at most, and bits for each entry below that.
FILTER_BITS, BITS_PER_ENTRY = 1 << 26, 16
#: Buckets of the hashed counts at most (one byte each in a task), and ranges by which tasks' tables are added up.
BUCKETS, RANGES = 1 << 24, 256
#: Ranges of first words by which tasks' pairs are added up.
PAIR_RANGES = 256
_END = b"\xff"                   # stands in no UTF-8 text
_KEPT = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of many pieces end to end: numbers into ``names`` (a dictionary array) and the piece of each."""
    names: pa.Array
    word: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> Words:
        """Cut bytes in which blanks part words and 0xFF parts pieces."""
        raw = np.frombuffer(data, np.uint8)
        ends = raw == 0xFF
        gap = ends | (raw == 32)
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        narrow = np.int32 if len(raw) < 1 << 31 else np.int64
        piece = np.cumsum(ends, dtype=narrow)[starts]
        body = raw[~gap]
        offsets = np.append(starts - np.cumsum(gap, dtype=narrow)[starts], len(body)) if len(starts) else np.zeros(1, np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
        coded = words.dictionary_encode()
        return cls(coded.dictionary, coded.indices.to_numpy().astype(np.int64), piece)

    def hashes(self, seed: int) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.array([digest(w, seed) for w in self.names.to_pylist()], dtype=np.uint64)

    def joined(self, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """The runs of words as strings."""
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths) + np.repeat(starts, lengths)
        parts = pa.LargeListArray.from_arrays(pa.array(offsets), self.names.take(pa.array(self.word[at])))
        return pc.binary_join(parts, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())


def _room(piece: np.ndarray) -> np.ndarray:
    """Words from each word to the end of its piece, itself included."""
    n = len(piece)
    last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if n else np.zeros(0, np.int64)
    return np.repeat(last, np.diff(np.concatenate([[-1], last]))) - np.arange(n) + 1


def parse(words: Words, period: int = PERIOD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks as (first word, number of words, whether the piece ends here)."""
    room = _room(words.piece)
    n = len(room)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    h = words.hashes(0)[words.word]
    window = np.zeros(n, np.uint64)
    for k in range(min(n, OVERLAP)):
        window[:n - k] += h[k:] * _ODD[k % 4] * np.uint64(2 * k + 1)
    cut = (room >= OVERLAP) & (_mix(window) % np.uint64(period) == 0)
    first = np.append(True, words.piece[1:] != words.piece[:-1])
    starts = np.flatnonzero(first | cut)
    follows = np.append(~first[starts[1:]], False)              # the next chunk is of the same piece
    lengths = np.where(follows, np.append(starts[1:], 0) - starts + OVERLAP, room[starts])
    # A window at the very end closes the chunk before it, and is itself the piece's last chunk.
    return starts, lengths, ~follows


def _gathered(batches: Iterator[pa.RecordBatch], clean) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, about ``GATHER`` words (six bytes each) at a time, with their other columns."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        lengths = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            done = lengths[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(lengths, done + 6 * GATHER - size, "right")))
            held.append(b.slice(lo, hi - lo))
            size += int(lengths[min(hi, b.num_rows) - 1] - done)
            lo = hi
            if size >= 6 * GATHER or lo < b.num_rows:
                yield from clean(pa.Table.from_batches(held).combine_chunks())
                held, size = [], 0
    if held:
        yield from clean(pa.Table.from_batches(held).combine_chunks())


def _by_lang(t: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    langs = t.column("lang").combine_chunks().dictionary_encode()
    code = langs.indices.to_numpy()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, t.take(pa.array(np.flatnonzero(code == i)))


def _chunk_rows(batches: Iterator[pa.RecordBatch], period: int) -> Iterator[pa.RecordBatch]:
    """``lang, last, text, n``: chunks and how often these texts have them, and their words (``last`` is null)."""
    def part(t: pa.Table):
        for lang, own in _by_lang(t):
            texts = own.column("text").combine_chunks().cast(pa.binary()).to_pylist()
            words = Words.of(_END.join(x.translate(_KEPT) for x in texts if x is not None))
            starts, lengths, last = parse(words, period)
            if not len(starts):
                continue
            counted = pa.table({"text": words.joined(starts, lengths), "last": last}).group_by(["text", "last"]).aggregate([([], "count_all")])
            names = words.names.cast(pa.binary()).cast(pa.string())
            for last, text, n in ((counted.column("last"), counted.column("text"), counted.column("count_all").cast(pa.int64())),
                                  (pa.nulls(len(names), pa.bool_()), names, pa.array(np.bincount(words.word)))):
                yield from pa.table([_lang_column(lang, len(n)), last, text, n], names=["lang", "last", "text", "n"]).to_batches(10_000)

    return _gathered(batches, part)


@dataclass
class Counted:
    """Chunks of one language: words, weights, and which n-gram starts belong to them."""
    words: Words
    weight: np.ndarray
    room: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Counted:
        texts = t.column("text").combine_chunks().cast(pa.binary()).to_pylist()
        words = Words.of(_END.join(texts))
        room = _room(words.piece)
        last = t.column("last").combine_chunks().to_numpy(zero_copy_only=False)[words.piece]
        return cls(words, t.column("n").combine_chunks().to_numpy()[words.piece], room, last | (room > OVERLAP))

    @staticmethod
    def summed(at: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of ``at`` and the summed weights of each distinct code."""
        by = np.argsort(code, kind="stable")
        sorted_ = code[by]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(by) else np.zeros(0, np.int64)
        return at[by][first], np.add.reduceat(weight[by], first) if len(by) else np.zeros(0, np.int64)


class Filter:
    """Bloom filter over 64-bit keys with two probes; bounded by ``FILTER_BITS``."""

    def __init__(self, bits: int, words: np.ndarray):
        self.mask, self.words = np.uint64(bits - 1), words

    @staticmethod
    def places(keys: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return keys & mask, (_mix(keys ^ _ODD[2])) & mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in self.places(keys, self.mask):
            found &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _lang_hash(lang: str, seed: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), seed + 1))


def _keys(lang: np.ndarray | np.uint64, *hashes: np.ndarray) -> np.ndarray:
    """The filter's key of a language and one or two word hashes."""
    out = lang
    for h in hashes:
        out = _mix((out + h) * _ODD[3])
    return out


def _filter_of(frequent: DataFrame, seed: int) -> Filter:
    """Filter of ``lang`` and word hashes ``h1`` (and ``h2``). At most ``FILTER_BITS`` / 64 longs reach the driver."""
    n = frequent.count()
    bits = 64
    while bits < min(FILTER_BITS, n * BITS_PER_ENTRY):
        bits *= 2
    hashes = [c for c in ("h1", "h2") if c in frequent.columns]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                langs = b.column("lang").dictionary_encode()
                own = np.array([_lang_hash(x, seed) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
                keys = _keys(own, *(b.column(c).to_numpy().view(np.uint64) for c in hashes))
                p = np.concatenate(Filter.places(keys, np.uint64(bits - 1)))
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)),
                                                  pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["at", "bit"])

    words = np.zeros(bits // 64, np.uint64)
    marked = frequent.select("lang", *hashes).mapInArrow(mark, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bit"))
    for r in marked.toLocalIterator():
        words[r["at"]] = np.int64(r["bit"]).view(np.uint64)
    return Filter(bits, words)


def _lang_column(lang: str, n: int) -> pa.Array:
    return pa.array([lang]).take(pa.array(np.zeros(n, np.int32)))


def _word_hashes(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, h1, f`` of counted words."""
    for b in batches:
        words = b.column("text").cast(pa.binary()).to_pylist()
        h = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("text"), pa.array(h.view(np.int64)), b.column("n")],
                                         names=["lang", "phrase", "h1", "f"])


def _begins(c: Counted, hashes: np.ndarray, lang: np.uint64, frequent: Filter, known: int) -> np.ndarray:
    """Whether the ``known`` words from each position may be frequent."""
    if known == 1:
        return frequent.has(_keys(lang, hashes))[c.words.word]
    h = hashes[c.words.word]
    begins = np.zeros(len(h), bool)
    inside = np.flatnonzero(c.room >= known)
    begins[inside] = frequent.has(_keys(lang, *(h[inside + i] for i in range(known))))
    return begins


def _starts(c: Counted, begins: np.ndarray, known: int, size: int) -> np.ndarray:
    """Positions of phrases of ``size`` words whose parts of ``known`` words may all be frequent."""
    at = np.flatnonzero(begins & c.counts & (c.room >= size))
    for i in range(1, size - known + 1):
        at = at[begins[at + i]]
    return at


def _buckets(lang: np.uint64, h: np.ndarray, at: np.ndarray, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Two buckets of each phrase, one in either half of the table."""
    half = buckets // 2
    one, two = Filter.places(_keys(lang, *(h[at + i] for i in range(size))), np.uint64(half - 1))
    return one.astype(np.int64), two.astype(np.int64) + half


def _hopeful(table: np.ndarray, lang: np.uint64, h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The positions whose phrase is promising in both buckets."""
    one, two = _buckets(lang, h, at, size, len(table))
    return at[table[one] & table[two]]


def _hashed_counts(batches: Iterator[pa.RecordBatch], seed: int, frequent, known: int, sizes: range, buckets: int,
                   least: int) -> Iterator[pa.RecordBatch]:
    """``part, counts``: a task's counts of phrases of these sizes by hash, none above ``least``."""
    table = np.zeros(buckets, np.min_scalar_type(least))
    bits = int(least).bit_length()

    def part(t: pa.Table):
        for lang, own in _by_lang(t):
            c = Counted.of(own)
            hashes = c.words.hashes(seed)
            h, code = hashes[c.words.word], _lang_hash(lang, seed)
            begins = _begins(c, hashes, code, frequent.value, known)
            for size in sizes:
                at = _starts(c, begins, known, size)
                weight = np.minimum(c.weight[at], least)
                for bucket in _buckets(code, h, at, size, buckets):
                    # Bucket and weight in one number: sorting these is far cheaper than ordering rows by bucket.
                    both = np.sort(bucket << bits | weight)
                    bucket = both >> bits
                    first = np.flatnonzero(np.diff(bucket, prepend=-1))
                    where = bucket[first]
                    n = np.add.reduceat(both & ((1 << bits) - 1), first) if len(first) else first
                    table[where] = np.minimum(table[where] + n, least)
        return ()

    for _ in _gathered(batches, part):
        pass
    if table.any():
        for i, x in enumerate(np.split(table, min(RANGES, buckets))):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "counts"])


def _promising(chunks: DataFrame, seed: int, frequent, known: int, sizes: range, buckets: int, least: int) -> np.ndarray:
    """Whether a bucket reaches ``least`` over all tasks. One bit per bucket reaches the driver."""
    kind = np.min_scalar_type(least)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def done():
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())],
                                                 names=["part", "bits"])

        for b in batches:
            for i, counts in zip(b.column("part").to_pylist(), b.column("counts")):
                x = np.frombuffer(counts.as_buffer(), kind)
                if i != now:
                    yield from done()
                    now, sums = i, np.zeros(len(x), np.int64)
                sums += x
        yield from done()

    tables = chunks.mapInArrow(lambda it: _hashed_counts(it, seed, frequent, known, sizes, buckets, least), "part int, counts binary")
    summed = tables.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, bits binary")
    out, parts = np.zeros(buckets, bool), min(RANGES, buckets)
    for r in summed.toLocalIterator():
        lo = r["part"] * (buckets // parts)
        out[lo:lo + buckets // parts] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:buckets // parts]
    return out


_PAIR = np.dtype([("h1", np.int64), ("h2", np.int64), ("f", np.int64)])


def _pair_rows(batches: Iterator[pa.RecordBatch], seed: int, frequent, hopeful) -> Iterator[pa.RecordBatch]:
    """``lang, part, pairs``: pairs of words that may both be frequent, with their counts. A row holds those of a
    range of first words, as ``_PAIR`` records sorted by pair."""
    def part(t: pa.Table):
        for lang, own in _by_lang(t):
            c = Counted.of(own)
            hashes = c.words.hashes(seed)
            h, code = hashes[c.words.word], _lang_hash(lang, seed)
            at = _starts(c, _begins(c, hashes, code, frequent.value, 1), 1, 2)
            at = _hopeful(hopeful.value, code, h, at, 2)
            first, f = c.summed(at, c.words.word[at] * len(hashes) + c.words.word[at + 1], c.weight[at])
            pairs = np.empty(len(first), _PAIR)
            pairs["h1"], pairs["h2"], pairs["f"] = h[first].view(np.int64), h[first + 1].view(np.int64), f
            pairs = pairs[np.lexsort((pairs["h2"], pairs["h1"]))]
            ranges = pairs["h1"] & (PAIR_RANGES - 1)
            pairs = pairs[np.argsort(ranges, kind="stable")]
            some, sizes = np.unique(ranges, return_counts=True)
            cut = np.split(pairs, np.cumsum(sizes)[:-1]) if len(some) else []
            yield pa.RecordBatch.from_arrays([_lang_column(lang, len(some)), pa.array(some.astype(np.int32)),
                                              pa.array([x.tobytes() for x in cut], pa.binary())], names=["lang", "part", "pairs"])

    return _gathered(batches, part)


def _summed_pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``lang, h1, h2, f`` of the pairs with ``f >= least``, from batches sorted by ``lang, part``."""
    now, held, rows = None, [], 0

    def added(parts: list[np.ndarray]) -> np.ndarray:
        pairs = np.concatenate(parts)
        pairs = pairs[np.lexsort((pairs["h2"], pairs["h1"]))]
        new = np.append(True, (pairs["h1"][1:] != pairs["h1"][:-1]) | (pairs["h2"][1:] != pairs["h2"][:-1]))
        first = np.flatnonzero(new)
        out = pairs[first]
        out["f"] = np.add.reduceat(pairs["f"], first)
        return out

    def done():
        if held:
            pairs = added(held)
            pairs = pairs[pairs["f"] >= least]
            yield pa.RecordBatch.from_arrays([_lang_column(now[0], len(pairs)), *(pa.array(pairs[c].copy()) for c in _PAIR.names)],
                                             names=["lang", *_PAIR.names])

    for b in batches:
        for lang, part, pairs in zip(b.column("lang").to_pylist(), b.column("part").to_pylist(), b.column("pairs")):
            if (lang, part) != now:
                yield from done()
                now, held, rows = (lang, part), [], 0
            held.append(np.frombuffer(pairs.as_buffer(), _PAIR))
            rows += len(held[-1])
            if rows > 2 * len(held[0]) + GATHER:                # a range's distinct pairs stay, not all that arrive
                held = [added(held)]
                rows = len(held[0])
    yield from done()


def _long_rows(batches: Iterator[pa.RecordBatch], seed: int, frequent, known: int, sizes: range, hopeful) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, size, f`` of phrases of these sizes whose parts of ``known`` words may all be frequent."""
    def part(t: pa.Table):
        for lang, own in _by_lang(t):
            c = Counted.of(own)
            hashes = c.words.hashes(seed)
            h, lang_code = hashes[c.words.word], _lang_hash(lang, seed)
            begins = _begins(c, hashes, lang_code, frequent.value, known)
            for size in sizes:
                at = _starts(c, begins, known, size)
                at = _hopeful(hopeful.value, lang_code, h, at, size)
                # Codes of equal phrases stay equal and small: numbered anew with each word.
                code = c.words.word[at]
                for i in range(1, size):
                    code = np.unique(code * (len(c.words.names) + 1) + c.words.word[at + i], return_inverse=True)[1]
                first, f = c.summed(at, code, c.weight[at])
                yield pa.RecordBatch.from_arrays(
                    [_lang_column(lang, len(first)), c.words.joined(first, np.full(len(first), size)),
                     pa.array(np.full(len(first), size, np.int32)), pa.array(f)], names=["lang", "phrase", "size", "f"])

    return _gathered(batches, part)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up equal phrases of a task, about ``GATHER`` rows at a time."""
    held: list[pa.RecordBatch] = []

    def done():
        t = pa.Table.from_batches(held).group_by(["lang", "phrase", "size"]).aggregate([("f", "sum")])
        held.clear()
        return t.select(["lang", "phrase", "size", "f_sum"]).rename_columns(["lang", "phrase", "size", "f"]).to_batches(10_000)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= GATHER:
            yield from done()
    if held:
        yield from done()


def dictionary(docs: DataFrame, period: int = PERIOD) -> DataFrame:
    """``lang, last, text, n``: the distinct chunks and their parse frequencies, and the words (``last`` is null) and theirs."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    found = rows.mapInArrow(lambda it: _chunk_rows(it, period), "lang string, last boolean, text string, n bigint")
    return found.groupBy("lang", "last", "text").agg(F.sum("n").alias("n"))


def phrase_counts(entries: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, size, f`` of every phrase of up to ``LONGEST`` words with ``f >= least``, ``lang, n``) from :func:`dictionary`."""
    spark = entries.sparkSession
    chunks, counted = entries.where("last IS NOT NULL"), entries.where("last IS NULL")
    for seed in range(8):
        words, words_path = staged_at(counted.select("lang", "text", "n").mapInArrow(
            lambda it: _word_hashes(it, seed), "lang string, phrase string, h1 bigint, f bigint"), "phrase-words")
        frequent_words = staged(words.where(F.col("f") >= least), "phrase-frequent-words")
        if words.groupBy("lang", "h1").count().where("count > 1").isEmpty():
            break
        discard(spark, words_path)
    else:
        raise RuntimeError("words share hashes under every seed")
    totals = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    n_words = int(totals.agg(F.sum("n")).first()[0] or 0)
    buckets = min(BUCKETS, max(1 << 13, 1 << (n_words // 8).bit_length()))
    share = spark.sparkContext.broadcast
    some = share(_filter_of(frequent_words, seed))
    hopeful = share(_promising(chunks, seed, some, 1, range(2, 3), buckets, least))
    pairs = staged(chunks.mapInArrow(lambda it: _pair_rows(it, seed, some, hopeful), "lang string, part int, pairs binary")
                   .repartition("lang", "part").sortWithinPartitions("lang", "part")
                   .mapInArrow(lambda it: _summed_pairs(it, least), "lang string, h1 bigint, h2 bigint, f bigint"), "phrase-pairs")
    near, longer = share(_filter_of(pairs, seed)), range(3, LONGEST + 1)
    hopes = share(_promising(chunks, seed, near, 2, longer, buckets, least))
    long = chunks.mapInArrow(lambda it: _merged(_long_rows(it, seed, near, 2, longer, hopes)), "lang string, phrase string, size int, f bigint") \
        .groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    name = frequent_words.select("lang", "h1", F.col("phrase").alias("w"))
    named = pairs.join(name.select("lang", "h1", F.col("w").alias("w1")), ["lang", "h1"]) \
        .join(name.select("lang", F.col("h1").alias("h2"), F.col("w").alias("w2")), ["lang", "h2"])
    counts = staged(frequent_words.select("lang", "phrase", F.lit(1).alias("size"), "f").union(
        named.select("lang", F.concat_ws(" ", "w1", "w2"), F.lit(2), "f")).union(long), "phrase-counts")
    discard(spark, words_path)
    return counts, totals


def score_phrases(counts: DataFrame, totals: DataFrame, top: int = TOP, nested_percent: int = NESTED_PERCENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` candidates."""
    candidates = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    run = lambda lo, n: F.array_join(F.slice("words", lo, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "words", F.col("size"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")) \
        .select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cut = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(n AS DECIMAL(17, 0)))"
                   " div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    weakest = cut.withColumn("score", score.cast("bigint")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("x"), F.first("a").alias("a"), F.first("n").alias("n"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda at: F.array_join(F.slice("words", at, m), " "))))
    around = candidates.where("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a") \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = weakest.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(nested_percent) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return alone.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score")) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocation_table(docs: DataFrame, period: int = PERIOD, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The collocations of ``docs(text, lang)``."""
    chunks, path = staged_at(dictionary(docs, period), "phrase-dictionary")
    counts, totals = phrase_counts(chunks, least)
    discard(docs.sparkSession, path)
    return score_phrases(counts, totals, top)


def _collocation_sql() -> str:
    """Every occurrence of every phrase, counted plainly."""
    upper = "".join(chr(65 + i) for i in range(26))
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
p AS (SELECT id, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p),
g AS MATERIALIZED (
  SELECT lang, m AS size, array_to_string(words[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, range(1, {LONGEST + 1}) r(m) WHERE len(words) >= m)
  GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM g WHERE size > 1 AND f >= {LEAST}),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, n.n,
             (1000 * k.a::HUGEINT * n.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
      FROM k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(words[1:k.k], ' ')
           JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(words[k.k + 1:], ' ')
           JOIN n ON n.lang = k.lang
      QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k.k) = 1),
i AS (SELECT lang, array_to_string(words[pos:pos + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, words, a, m, unnest(range(1, size - m + 2)) AS pos FROM c, range(2, {LONGEST}) r(m) WHERE m < size)
      GROUP BY 1, 2),
o AS (SELECT s.* FROM s LEFT JOIN i ON s.lang = i.lang AND s.phrase = i.phrase WHERE i.longer IS NULL OR 100 * i.longer < {NESTED_PERCENT} * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o QUALIFY rank <= {TOP}
"""


COLLOCATION_SQL = _collocation_sql()
