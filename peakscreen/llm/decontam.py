"""Benchmark decontamination by winnowing, in DataFrame operations only.

Spans of ``WINDOW`` words shared by a document and a benchmark item are found in
three steps:

1. Winnowing: of the hashes of all k-grams, those that are the smallest of some
   ``w`` neighbouring ones are kept, with k + w - 1 = span length. Any shared
   span of that length has the same neighbourhood on both sides, so it shares
   at least one kept hash.
2. The kept hashes of documents are joined with the distinct ones of the benchmark.
3. A hit is extended: the windows that contain the k-gram are compared, word by
   word as text, with the benchmark's windows. The union of the windows found is hit.

An item of fewer words is one window of its own length; each short length that
occurs (at most nine) is winnowed apart with its own k and w.

Defined cases: null and wordless texts have no words and no window; an item
without words never occurs; equal items are separate items; rows with equal
id and text are separate rows with the same result; an empty benchmark hits nothing;
an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakscreen.llm.common import boxed, let, lower_ascii, staged, unboxed

#: A word: letters, digits and everything beyond ASCII; the class form that Java scans fastest.
WORD = r"[\p{Alnum}\P{ASCII}]+"
WINDOW = 10
KGRAM = 5


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)),
                      F.array().cast("array<string>"))


def _upto(last: Column) -> Column:
    """0 ... last, or nothing if last < 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def winnowed(tokens: Column, k: int, w: int) -> Column:
    """``array<struct<pos, h>>``: the k-gram hashes that are smallest among w neighbours."""
    def kept(grams: Column) -> Column:
        n = F.size(grams)
        lows = F.transform(_upto(n - w), lambda i: F.least(*[F.get(grams, i + j) for j in range(w)])
                           if w > 1 else F.get(grams, i))

        def select(low: Column) -> Column:
            def is_low(i: Column) -> Column:
                around = [F.get(low, i - j) for j in range(w)]
                return F.get(grams, i) == (F.greatest(*around) if w > 1 else around[0])

            at = F.filter(_upto(n - 1), is_low)
            return F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(grams, i).alias("h")))

        return let(lows, select)

    def grams(hashed: Column) -> Column:
        return F.transform(_upto(F.size(hashed) - k),
                           lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)]))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda hs: let(grams(hs), kept))


def _window(tokens: Column, start: Column, length: int) -> Column:
    return F.array_join(F.slice(tokens, start + 1, length), " ")


def _windows(tokens: Column, span: int) -> Column:
    return let(tokens, lambda t: F.transform(_upto(F.size(t) - span), lambda i: _window(t, i, span)))


def _hit_windows(docs: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """``id, text_hash, start, win``: occurrences in ``docs`` of ``items`` windows of ``span`` words."""
    k = min(KGRAM, span)
    w = span - k + 1
    probe = staged(items.select("item", "tokens").distinct()
                   .select(F.explode(winnowed(F.col("tokens"), k, w)).alias("f"))
                   .select("f.h").distinct(), "decontam-test-prints")
    wins = staged(items.select("win").distinct(), "decontam-test-windows")
    prints = docs.select("_id", "_th", F.explode(winnowed(words(F.col("text")), k, w)).alias("f"))
    near = staged(prints.select("_id", "_th", F.col("f.pos").alias("pos"), F.col("f.h").alias("h"))
                  .join(probe, "h", "left_semi").select("_id", "_th", "pos").distinct()
                  .groupBy("_id", "_th").agg(F.collect_list("pos").alias("at")), "decontam-hits")
    n = near.select(F.col("_id").alias("_nid"), F.col("_th").alias("_nth"), "at")
    # Rows with equal id and text have the same windows: one of them is enough.
    hit = docs.join(n, docs["_id"].eqNullSafe(n["_nid"]) & (docs["_th"] == n["_nth"])) \
        .select("_id", "_th", words(F.col("text")).alias("tokens"), "at")

    def spans(t: Column) -> Column:
        starts = F.array_distinct(F.flatten(F.transform(F.col("at"), lambda p: F.sequence(
            F.greatest(p - (span - k), F.lit(0)), p))))
        return F.transform(F.filter(starts, lambda s: s + span <= F.size(t)),
                           lambda s: F.struct(s.alias("start"), _window(t, s, span).alias("win")))

    found = hit.select("_id", "_th", F.explode(let(F.col("tokens"), spans)).alias("s")).select(
        "_id", "_th", "s.start", "s.win").distinct()
    return found.join(wins, "win", "left_semi").withColumn("end", F.col("start") + span)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, text_hash, n_hit, n_items, item_ids`` of the documents (id, text) with a hit."""
    base = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), "text") \
        .where(F.col("text").isNotNull())
    tokens = benchmark.select(F.col("item_id").cast("string").alias("item"),
                              words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    tokens = staged(tokens, "decontam-items")
    lengths = [r["n"] for r in tokens.where(F.size("tokens") < window)
               .select(F.size("tokens").alias("n")).distinct().collect()]   # at most window - 1
    parts, pairs = [], []
    for span in [*sorted(lengths), window]:
        size = F.size("tokens")
        own = tokens.where(size >= window) if span == window else tokens.where(size == span)
        wins = own.select("item", "tokens", F.explode(_windows(F.col("tokens"), span)).alias("win"))
        parts.append(_hit_windows(base, wins, span))
        pairs.append(wins.select("win", "item").distinct())
    found = staged(reduce(DataFrame.union, [p.select("_id", "_th", "start", "end", "win") for p in parts]),
                   "decontam-windows")
    earlier = (Window.partitionBy("_id", "_th").orderBy("start", "end")
               .rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.max("end").over(earlier)))
    covered = found.select("_id", "_th", new.alias("new")).groupBy("_id", "_th").agg(
        F.sum("new").cast("long").alias("n_hit"))
    owners = staged(reduce(DataFrame.union, pairs), "decontam-owners")
    named = (found.select("_id", "_th", "win").distinct().join(owners, "win")
             .groupBy("_id", "_th").agg(F.sort_array(F.collect_set("item")).alias("item_ids")))
    both = covered.withColumnRenamed("_id", "_i").withColumnRenamed("_th", "_t")
    return both.join(named, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th"))).select(
        "_id", "_th", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def decontam_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = staged(hits(docs, benchmark), "decontam-found")
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), count.alias("n_words"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"])
                       & (F.col("_text_hash") == F.col("_th")), "left")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    ids = F.coalesce(F.array_join("item_ids", ","), F.lit(""))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"),
                         F.coalesce("n_items", zero).alias("n_items"),
                         F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, same columns."""
    found = staged(hits(docs, benchmark).select("_id", "_th"), "decontam-found")
    marked = boxed(docs, id=F.col("doc_id"), text_hash=F.xxhash64("text"))
    return unboxed(marked.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")), "left_anti"))


DECONTAM_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS t FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(t)) AS span,
        unnest(list_transform(range(1, greatest(len(t) - 9, 1) + 1),
               lambda s: array_to_string(t[s:s + 9], ' '))) AS win FROM i WHERE len(t) > 0),
dw AS (SELECT rid, span, unnest(range(1, len(t) - span + 2)) AS s, t
       FROM d, (SELECT DISTINCT span FROM iw) WHERE len(t) >= span),
h AS (SELECT rid, s, dw.span, item FROM (SELECT rid, span, s, array_to_string(t[s:s + span - 1], ' ') AS win FROM dw) dw
      JOIN iw ON iw.win = dw.win AND iw.span = dw.span),
p AS (SELECT rid, count(DISTINCT pos)::BIGINT AS n_hit FROM (
        SELECT rid, unnest(range(s, s + span)) AS pos FROM (SELECT DISTINCT rid, s, span FROM h)) GROUP BY rid),
n AS (SELECT rid, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY rid)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN n USING (rid)
"""
