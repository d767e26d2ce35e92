"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each document gets whole-number measures. Per language and source a quantile
sketch of each measure is built: a histogram over buckets that keep the six
leading bits of a value, so a quantile is off by under 1/32 of its value.
Sketches are tables of counts: they merge by adding, in any order and exactly
alike on every run. The fences are the quartiles widened by three interquartile ranges,
or by the measure's least slack where the range is narrow. A group with fewer than
``MIN_GROUP`` rows takes the merged sketch of its language, and a language with
fewer the one of all rows. Documents are joined with their group's fences and filtered.

Documents that fail the base rule (under 50 words, or more than half the words in
repeated three-word windows) are rejected and stay out of the sketches.

Defined cases: a null or wordless text has measures 0 and fails the base rule; null
languages and sources are groups of their own; equal rows are judged alike; an empty table
gives an empty table; the filter keeps all columns of the input.

Windows of three words are told apart by a 64-bit hash within their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakscreen.llm.common import WORD, boxed, let, staged, unboxed

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_GROUP = 30
FENCE = 3
SPACES = " \t\n\x0b\x0c\r"
#: Measure: least slack, and whether low values are fenced as well. Rates are per thousand.
MEASURES = {"symbol_rate": (20, False), "dup_line_rate": (200, False), "repeat_rate": (150, False),
            "upper_rate": (150, False), "word_length": (150, True)}


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""
    n_windows = F.size(words) - 2
    grams = F.when(n_windows > 0, let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - 3),
        lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))).otherwise(
        F.array().cast("array<bigint>"))

    def covered(found: Column) -> Column:
        """Size of the union of [p, p + 3) over ascending positions."""
        return F.aggregate(F.transform(found, lambda p, i: F.least(
            F.lit(3), F.coalesce(F.get(found, i + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x)

    def count(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        repeated = let(placed, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: (
            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))), lambda x: x["p"])))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(repeated, covered))

    return let(grams, count)


def measured(docs: DataFrame) -> DataFrame:
    """Append ``_m``: a struct of the base counts and the measures (all long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    by_word = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))
    by_line = let(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    m = docs.withColumn("_w", by_word).withColumn("_l", by_line) \
        .withColumn("_s", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")) \
        .withColumn("_u", F.regexp_count(text, F.lit(r"[A-Z]")).cast("long"))

    def rate(part: Column, whole: Column, by: int = 1000) -> Column:
        return F.floor(F.lit(by).cast("long") * part / F.greatest(whole, F.lit(1))).cast("long")

    w, x = F.col("_w"), F.col("_l")
    return m.withColumn("_m", F.struct(
        w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), F.col("_s").alias("n_symbols"),
        x["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
        ((w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEAT_PERCENT * w["n_words"])).alias("base_failed"),
        rate(F.col("_s"), w["word_chars"]).alias("symbol_rate"),
        rate(x["n_dup_lines"], x["n_lines"]).alias("dup_line_rate"),
        rate(w["n_repeat_words"], w["n_words"]).alias("repeat_rate"),
        rate(F.col("_u"), w["word_chars"]).alias("upper_rate"),
        rate(w["word_chars"], w["n_words"], 100).alias("word_length"))).drop("_w", "_l", "_s", "_u")


def bucket(value: Column) -> Column:
    """The value with all but its six leading bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    low = F.pow(F.lit(2.0), drop).cast("long")
    return value - F.pmod(value, low)


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n`` from rows with lang, source and the measures."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket"))
                               for m in MEASURES])).alias("x")
    return rows.select("lang", "source", each).groupBy(
        "lang", "source", F.col("x.measure").alias("measure"), F.col("x.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts add up."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Per group: its rows and, per measure, the upper (and lower) fence."""
    gathered = sketch.groupBy(*keys, "measure").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("h"))

    def quantile(quarters: int) -> Column:
        # First bucket whose running count reaches the share; a sketch has a few hundred buckets.
        state = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
        return F.aggregate("h", state, lambda s, x: F.struct(
            (s["seen"] + x["n"]).alias("seen"),
            F.when(s["at"].isNull() & ((s["seen"] + x["n"]) * 4 >= quarters * F.col("n")), x["bucket"])
            .otherwise(s["at"]).alias("at")))["at"]

    q = gathered.withColumn("q1", quantile(1)).withColumn("q3", quantile(3))
    out = []
    for m, (slack, both) in MEASURES.items():
        mine = F.col("measure") == m
        wide = F.greatest(FENCE * (F.col("q3") - F.col("q1")), F.lit(slack))
        out.append(F.max(F.when(mine, F.col("q3") + wide)).alias(f"{prefix}{m}_high"))
        if both:
            out.append(F.max(F.when(mine, F.col("q1") - wide)).alias(f"{prefix}{m}_low"))
    return q.groupBy(*keys).agg(F.max("n").alias(f"{prefix}n"), *out)


def fences(rows: DataFrame) -> DataFrame:
    """``lang, source`` and the fences that hold for the group, from rows that passed the base rule."""
    fine = staged(sketches(rows), "quality-sketch")
    by_lang = merge(fine, ["lang"]).withColumnRenamed("lang", "_lang")
    own = _fences(fine, ["lang", "source"], "a_")
    lang = _fences(by_lang, ["_lang"], "b_")
    every = _fences(merge(fine, []).withColumn("_all", F.lit(1)), ["_all"], "c_")
    x = own.join(lang, own["lang"].eqNullSafe(lang["_lang"])).join(every, F.lit(1) == F.col("_all"))
    names = [c[2:] for c in own.columns if c.startswith("a_") and c != "a_n"]
    return x.select("lang", "source", *[
        F.when(F.col("a_n") >= MIN_GROUP, F.col("a_" + c)).when(F.col("b_n") >= MIN_GROUP, F.col("b_" + c))
        .otherwise(F.col("c_" + c)).alias(c) for c in names])


def _within() -> Column:
    tests = []
    for m, (_, both) in MEASURES.items():
        tests.append(F.col(f"_m.{m}") <= F.col(f"{m}_high"))
        if both:
            tests.append(F.col(f"_m.{m}") >= F.col(f"{m}_low"))
    return reduce(Column.__and__, tests)


def judged(rows: DataFrame) -> DataFrame:
    """Append ``kept`` to rows with lang, source and ``_m``."""
    passed = rows.where(~F.col("_m.base_failed")).select(
        "lang", "source", *[F.col(f"_m.{m}").alias(m) for m in MEASURES])
    f = staged(fences(passed), "quality-fences")
    f = f.withColumnsRenamed({"lang": "_flang", "source": "_fsource"})
    joined = rows.join(f, rows["lang"].eqNullSafe(f["_flang"]) & rows["source"].eqNullSafe(f["_fsource"]), "left")
    ok = ~F.col("_m.base_failed") & F.coalesce(_within(), F.lit(False))
    return joined.withColumn("kept", ok).drop(*f.columns)


def quality_table(docs: DataFrame) -> DataFrame:
    """Per document the base counts and the verdict."""
    rows = staged(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-measures")
    return judged(rows).select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines",
                               "_m.n_repeat_words", "_m.base_failed", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The kept documents, same columns. The text is measured twice rather than shuffled."""
    rows = boxed(docs, text=F.col("text"), lang=F.col("lang"), source=F.col("source"))
    return unboxed(judged(measured(rows)).where("kept"))


def _fence_sql(name: str, source: str, keys: str) -> str:
    part = f"PARTITION BY {keys + ', ' if keys else ''}measure"
    group = f"{keys + ', ' if keys else ''}"
    return f"""{name}c AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS cum, sum(n) OVER ({part}) AS total FROM {source}),
{name}q AS (SELECT {group}measure, max(total)::BIGINT AS n, min(CASE WHEN cum * 4 >= total THEN bucket END) AS q1,
  min(CASE WHEN cum * 4 >= 3 * total THEN bucket END) AS q3 FROM {name}c GROUP BY {group}measure),
{name}f AS (SELECT {group}measure, n, q3 + greatest(3 * (q3 - q1), slack) AS high, q1 - greatest(3 * (q3 - q1), slack) AS low
  FROM {name}q JOIN slacks USING (measure))"""


QUALITY_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (
    SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rep AS (SELECT rid, gram FROM g GROUP BY rid, gram HAVING count(*) > 1),
cov AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (
    SELECT g.rid, unnest([i, i + 1, i + 2]) AS p FROM g JOIN rep ON g.rid = rep.rid AND g.gram = rep.gram) GROUP BY rid),
b AS (SELECT t.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper
    FROM t LEFT JOIN cov USING (rid)),
m AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    1000 * n_symbols // greatest(word_chars, 1) AS symbol_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 1000 * n_upper // greatest(word_chars, 1) AS upper_rate,
    100 * word_chars // greatest(n_words, 1) AS word_length FROM b),
slacks(measure, slack) AS (VALUES """ + ", ".join(f"('{m}', {s})" for m, (s, _) in MEASURES.items()) + r"""),
v AS (UNPIVOT (SELECT rid, lang, source, base_failed, """ + ", ".join(MEASURES) + r""" FROM m)
    ON """ + ", ".join(MEASURES) + r""" INTO NAME measure VALUE value),
sk AS (SELECT lang, source, measure, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bucket,
    count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
skl AS (SELECT lang, measure, bucket, sum(n) AS n FROM sk GROUP BY ALL),
ska AS (SELECT measure, bucket, sum(n) AS n FROM sk GROUP BY ALL),
""" + _fence_sql("a", "sk", "lang, source") + ",\n" + _fence_sql("b", "skl", "lang") + ",\n" + _fence_sql("c", "ska", "") + r""",
fence AS (SELECT af.lang, af.source, measure,
    CASE WHEN af.n >= 30 THEN af.high WHEN bf.n >= 30 THEN bf.high ELSE cf.high END AS high,
    CASE WHEN measure <> 'word_length' THEN 0 WHEN af.n >= 30 THEN af.low WHEN bf.n >= 30 THEN bf.low ELSE cf.low END AS low
    FROM af JOIN bf USING (measure) JOIN cf USING (measure) WHERE af.lang IS NOT DISTINCT FROM bf.lang),
ok AS (SELECT rid, bool_and(value <= high AND value >= low) AS fits FROM v JOIN fence
    ON v.measure = fence.measure AND v.lang IS NOT DISTINCT FROM fence.lang AND v.source IS NOT DISTINCT FROM fence.source GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    (NOT base_failed AND coalesce(fits, false)) AS kept FROM m LEFT JOIN ok USING (rid)
"""
