"""Registered queries and operators against SQL, brute force, round trips and held-out accuracy."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from peakscreen.llm import (
    catalog,
    chat_format,
    decontam,
    mil_quality,
    mixing,
    quality_rules,
    sharding,
    token_store,
    toxicity,
)
from peakscreen.llm.common import shared_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, item string, win string"


def docs_of(spark, rows):
    """Rows of (doc_id, text, lang, source), with extra columns whose names the operators use."""
    return spark.createDataFrame([(d, t, g, s, 1, "z", "z", "z") for d, t, g, s in rows], DOC)


def odd_rows():
    text = "The quick brown fox jumps over the lazy dog and then some more words follow here " * 6
    return [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, None, None), (None, "", "en", None),
            (3, "x " * 30000, "en", "b"), (4, "# $ %\n# $ %\n\x0b", None, "b"), (5, text.upper(), "de", "a"),
            (None, "été straße 中文 " * 20, "fr", "c")]


def same_as_sql(frame, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    want = con.sql(sql)
    names = sorted(want.columns)
    assert sorted(frame.columns) == names
    rows = sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)
    assert rows == sorted((tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall()), key=str)
    return rows


def test_sql_operators_on_odd_rows(spark):
    docs = docs_of(spark, odd_rows())
    bench = spark.createDataFrame(
        [(1, "over the lazy dog and then some more words follow HERE the"), (2, "brown fox"), (3, "中文 Été"), (4, ""),
         (5, None), (6, "one two three four five six seven eight nine ten"), (7, "brown fox")], "item_id long, text string")
    for case in (docs, docs.where("false")):
        same_as_sql(quality_rules.quality_table(case), quality_rules.QUALITY_SQL, documents=case)
        same_as_sql(mixing.mix_table(case), mixing.MIX_SQL, documents=case)
        same_as_sql(decontam.decontam_table(case, bench), decontam.DECONTAM_SQL, documents=case, benchmark=bench)
    none = bench.where("false")
    assert decontam.clean(docs, none).count() == docs.count()
    hit = {r["doc_id"] for r in decontam.decontam_table(docs, bench).where("contaminated").collect()}
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, 4, 5, None} - hit | {None}
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality_rules.quality_table(docs).where("kept").count()


def test_mix_takes_near_target(spark):
    rows = [(i, "w " * (20 + i % 9), "en", f"s{i % 5}" if i % 3 else "hot") for i in range(3000)]
    out = mixing.mix_table(docs_of(spark, rows)).join(
        docs_of(spark, rows).select("doc_id", "source"), "doc_id")
    per = out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s"),
                                    F.sum(F.col("size") * F.col("size")).alias("sq")).collect()
    for r in per:       # within four standard deviations of the Bernoulli draws
        part = r["g"] / r["s"] % 1
        assert abs(r["t"] - r["g"]) <= 4 * (part * (1 - part) * r["sq"]) ** 0.5 + 1e-6 and r["g"] <= 3 * r["s"]
    assert sum(r["g"] for r in per) == pytest.approx(sum(r["s"] for r in per))
    assert out.where("taken > 3 * size").count() == 0
    mixed = mixing.mix(docs_of(spark, rows))
    assert mixed.count() == out.agg(F.sum(F.col("taken") / F.col("size"))).first()[0]


def test_hash_tree(spark):
    docs = docs_of(spark, [(i, f"t{i % 7}", "en", "s") for i in range(100, 4100)] + odd_rows())
    out = sharding.shard_table(docs).collect()
    assert len(out) == docs.count()
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in out)
    moved = sum(r["grown_shard"] == 40 for r in out)
    assert 0.5 < moved / (len(out) / 41) < 1.7
    r = next(x for x in out if x["doc_id"] == 4)
    text = odd_rows()[5][1].encode()
    assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
    assert sharding.shard_table(docs.where("false")).collect() == []
    # A heavier shard takes rows from everywhere above it, but nothing else moves between other regions.
    tree, heavy = sharding.PRODUCTION, sharding.PRODUCTION.reweighted(7, 3.0)
    both = sharding.assign(sharding.assign(docs, tree, "doc_id"), heavy, "doc_id", "later").where("shard != later").collect()
    assert both and all(r["later"] < 20 for r in both if r["shard"] >= 20)
    assert not [r for r in both if r["shard"] < 20 <= r["later"]]
    assert all(5 <= r["later"] < 10 for r in both if r["shard"] < 20)


def test_token_store_round_trip(spark):
    from tokenizers import Tokenizer

    vocabulary = catalog.tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_str(vocabulary)
    plain.encode_special_tokens = True
    texts = [None, "", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "don't stop's", "été Straße 中文 ǆ", "x\ny\nz", "x\n\ny",
             "<|endoftext|> 12 ab3", "tab\tand\x0bmore nbsp", "a'b c,d e.\nF", "w%%% th&&& | .", "Wort " * 20000, "🙂 x🙂", "ªº µ ¼"]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, "a", "en", "s"), (None, "null id", "en", "s")])
    path = shared_path(spark, "store-test")
    token_store.write_store(docs, path, vocabulary)
    got = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(texts))]
    at = 0
    for r in got:
        text = "null id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        raw = np.array(plain.encode(text, add_special_tokens=False).ids + [0], dtype="<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw)), text[:20]
        at += len(raw) // 4
    assert [len(x) for x in token_store.fetch(spark, path, 3)] == [2, 2]
    empty = shared_path(spark, "store-empty")
    token_store.write_store(docs.where("false"), empty, vocabulary)
    assert token_store.read_documents(spark, empty).collect() == []


def test_token_store_query_gives_control_strings_their_ids(spark, monkeypatch):
    """op8 as the tokenizers library encodes, nothing set on it."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(catalog.tokenizer_file("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext|> <|endoftext|>\n\n", "<|endoftext| >", "plain text", None]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    monkeypatch.setattr(catalog, "table", lambda *_: docs)
    got = sorted(catalog.op8_token_store(spark, "unused").collect(), key=lambda r: r["doc_id"])
    at = 0
    for r, text in zip(got, texts, strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids
        assert (50256 in ids) == ("<|endoftext|>" in (text or ""))
        raw = np.array(ids + [0], dtype="<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw)), text
        at += len(raw) // 4


def test_chat_round_trip(spark, monkeypatch):
    vocabulary = catalog.tokenizer_file("byte_bpe_50k.json")
    tricky = "<|end|> <\\|end|> <\\\\/s> [INST] [\\/INST] <s><<SYS>> été\n"
    assert chat_format.unescape(chat_format.escape(tricky)) == tricky
    assert not any(c in chat_format.escape("".join(chat_format.CONTROL)) for c in chat_format.CONTROL)
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"),
            (2, None, None, None), (2, 0, "assistant", ""), (None, 5, "assistant", "n"), (3, 0, "assistant", "long " * 30000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for chunk in (chat_format.CHUNK, 8):
        monkeypatch.setattr(chat_format, "CHUNK", chunk)
        out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df, vocabulary), vocabulary).collect()}
        for conv in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
            said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
            loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
            got = out[conv]
            assert (got["n_turns"], got["turns_sha256"]) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
            assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(df.where("false"), vocabulary), vocabulary).collect() == []


def test_ordinal_fit_recovers_order_and_thresholds():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 6)) < 0.3
    eta = x @ np.array([2.0, 1.0, -1.5, 0, 0, 0])
    draw = rng.random(4000)
    y = (draw < toxicity.sigmoid(eta - 0.5)).astype(int) + (draw < toxicity.sigmoid(eta - 2.0))
    m = toxicity.fit_ordinal([np.flatnonzero(r).astype(np.int32) for r in x], y, 3)
    assert m.thresholds == pytest.approx([0.5, 2.0], abs=0.3)
    assert [m.weights.get(i, 0.0) for i in range(3)] == pytest.approx([2.0, 1.0, -1.5], abs=0.4)


def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    out = toxicity.toxicity_table(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    assert sum(r["toxic"] == bool(r["label"]) for r in out) / len(out) > 0.9
    odd = docs_of(spark, odd_rows())
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(odd, model)
    assert scored.columns == [*odd.columns, "severity"] and scored.count() == odd.count()
    for r in scored.collect():      # the cached scan agrees with the plain one
        eta = sum(model.weights.get(f, 0.0) for f in toxicity.features(r["text"]))
        assert r["severity"] == pytest.approx(float(model.severity(eta)))
    assert toxicity.reject_toxic(odd, labels.where("false")).count() == odd.count()
    assert toxicity.reject_toxic(docs.where("false"), labels).collect() == []


def test_mil_gradients_and_held_out(spark):
    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(n, mil_quality.WIDTH)) for n in (1, 3, 2)]
    model = mil_quality.train([b + 3 * (i == 1) for i, b in enumerate(bags * 20)], np.array([0, 1, 0] * 20))
    x, firsts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([0.0, 1.0, 0.0])
    g = mil_quality.gradients(model.params, x, firsts, y)

    def loss(p):
        s = mil_quality.forward(p, x, firsts)["y"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, at in (("E", (2, 3)), ("V", (1, 2)), ("U", (0, 1)), ("w", (3,)), ("c", (2,)), ("e", (1,)), ("b", ())):
        up, down = ({**model.params, k: np.array(model.params[k])} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(g[k][at], abs=1e-6)
    docs, labels = labelled(spark)
    out = mil_quality.quality_table(docs, labels).join(labels.select("doc_id", "quality"), "doc_id")
    held = out.where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.collect())
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.85
    odd = docs_of(spark, odd_rows())
    scores = mil_quality.quality_table(odd, labels).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert mil_quality.quality_table(odd.where("false"), labels).collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now, seen = docs.columns, docs, {}
    for name, stage in cp.STAGES:
        seen[name] = now.collect(), (out := stage(spark, now, SF)).collect()
        assert name == cp.STAGES[-1][0] or out.columns == columns
        now = spark.createDataFrame(out.collect(), out.schema)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    assert sum(words(r["text"]) for r in after) == pytest.approx(sum(words(r["text"]) for r in before), rel=0.5)
    assert len(seen["sharding"][0]) == len(seen["sharding"][1]) == cp.run(spark, SF).count()
    empty = docs.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).collect() == []
