"""Columns whose names the operators use themselves come back unchanged."""

import pytest
from pyspark.sql import functions as F

from peakscreen.llm import decontam, mixing, quality_rules, sharding, simhash_dedup, toxicity

SF = "/root/testdata/sf0.001"
NAMES = ["copies", "rate", "target", "source_size", "kept", "_text_hash", "_lines", "_removed", "symbol_rate_high", "row", "id",
         "text_hash", "_id", "_th", "copy", "_m", "_w", "fp", "component", "severity", "size", "a.b", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def clashing(docs):
    extra = [F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in NAMES]
    return docs.select("*", *extra).cache()


@pytest.mark.parametrize("name", ["mix", "filter", "keep_one", "clean", "reject_toxic", "assign"])
def test_operator_leaves_clashing_columns_alone(spark, docs, clashing, name):
    benchmark, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "labels"))
    run = {"mix": mixing.mix, "filter": quality_rules.filter_documents, "keep_one": simhash_dedup.keep_one,
           "clean": lambda d: decontam.clean(d, benchmark), "reject_toxic": lambda d: toxicity.reject_toxic(d, labels),
           "assign": lambda d: sharding.assign(d, sharding.PRODUCTION, "doc_id")}[name]
    plain, got = run(docs), run(clashing)
    cols = docs.columns
    assert got.columns == clashing.columns + [c for c in plain.columns if c not in cols]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, plain.select(cols).collect()), key=str)
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in got.collect() for n in NAMES)
