"""Collocations from the parse against counting every occurrence in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from peakscreen.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, top=co.TOP):
    upper = {65 + i: 97 + i for i in range(26)}
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    nested = set()
    for (lang, w), a in cand.items():
        nested |= {(lang, w[i:i + m]) for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * a >= 100 * f[lang, w[i:i + m]]}
    out = []
    for lang in {k[0] for k in cand}:
        scored = []
        for (own, w), a in cand.items():
            if own == lang and (lang, w) not in nested:
                score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), w, k))
        for rank, (score, a, _, w, k) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, " ".join(w), -a, f[lang, w[:k]], f[lang, w[k:]], n[lang], -score))
    return sorted(out)


def run(spark, rows, **params):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in co.collocation_table(df, **params).collect())


def made(seed, n, words=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" if i % 7 else f"É{i}ß" for i in range(words)]
    common = "To be or not to be that is the question of the whole day".split()

    def text():
        out = []
        for _ in range(rng.randrange(0, 60)):
            out += rng.choices(vocab, k=rng.randrange(1, 4)) if rng.random() < .8 else common[:rng.randrange(2, 14)]
            out.append(rng.choice(["", "", "", ",", ".", " ;", "\n", "\t", "  "]))
        return " ".join(out)
    return [(text(), rng.choice(["en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("period", [1, 3, 12, 10 ** 6])
def test_equals_plain_counts(spark, period):
    rows = made(period, 120)
    rows += [rows[0]] * 40 + [(None, "en"), ("", "en"), ("...", None), ("a a a a a a a a", "x"), ("a b", ""), ("Ä ä " * 9, "")]
    assert run(spark, rows, period=period, least=8) == plain(rows, 8)


def test_top_and_ties(spark):
    rows = [("p q, r s, t u, v w", "en")] * 5
    assert run(spark, rows, least=5, top=3) == plain(rows, 5, 3)


def test_long_texts_and_words(spark):
    rows = made(1, 60) + [(" ".join(made(2, 1, 5)[0][0].split() * 60), "en"), ("z" * 200_000, "en")]
    whole = run(spark, rows, least=8)
    assert whole == plain(rows, 8)


def test_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "FILTER_BITS", 64)
    monkeypatch.setattr(co, "BUCKETS", 2)
    rows = made(3, 80)
    assert run(spark, rows, least=6) == plain(rows, 6)


def test_filter_has_all_its_keys():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    words = np.zeros(1 << 10, np.uint64)
    for p in co.Filter.places(keys, np.uint64((1 << 16) - 1)):
        np.bitwise_or.at(words, (p >> np.uint64(6)).astype(int), np.uint64(1) << (p & np.uint64(63)))
    assert co.Filter(1 << 16, words).has(keys).all()


def test_empty_table_and_clashing_names(spark):
    assert co.collocation_table(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("one two one two", "en")] * 4
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).selectExpr(
        "*", "1 AS n", "2 AS last", "'x' AS phrase", "3 AS f", "4 AS score", "5 AS h1")
    assert sorted(tuple(r) for r in co.collocation_table(df, least=4).collect()) == plain(rows, 4)


class _All:
    """Stands for a broadcast filter, or table of hopeful buckets, that lets everything through."""
    value = None

    def has(self, keys):
        return np.ones(len(keys), bool)


def test_a_task_sends_a_row_for_each_range_of_pairs_not_for_each_pair():
    import pyarrow as pa
    every, table = _All(), _All()
    every.value, table.value = every, np.ones(4, bool)
    words = [f"w{i}" for i in range(200)]
    text = " ".join(f"{a} {b}" for a in words for b in words)
    chunks = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "last": [True] * 3, "text": [text, "a b a b", "w1 w2 w1"], "n": [1, 3, 5]})
    sent = list(co._pair_rows(iter([chunks]), 0, every, table))
    assert sum(b.num_rows for b in sent) <= co.PAIR_RANGES + 2
    rows = pa.Table.from_batches(sent + sent).sort_by([("lang", "ascending"), ("part", "ascending")]).combine_chunks().to_batches()
    got = {(r["lang"], r["h1"], r["h2"]): r["f"] for b in co._summed_pairs(iter(rows), 4) for r in b.to_pylist()}
    h = lambda w: int(np.array([co.xxhash.xxh64_intdigest(w.encode(), 0)], np.uint64).view(np.int64)[0])
    want = Counter()
    for lang, body, n in (("en", text, 1), ("de", "a b a b", 3), ("en", "w1 w2 w1", 5)):
        own = body.split()
        for a, b in zip(own, own[1:]):
            want[lang, h(a), h(b)] += 2 * n
    assert got == {key: n for key, n in want.items() if n >= 4}
