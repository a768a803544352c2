from __future__ import annotations

import os

import pytest

import corpus_pipeline
from seqweave.llm import mixing, queries, toxicity
from seqweave.llm._common import written

from .test_dedup import classes
from .test_files import brute_tokens
from .test_texts import brute_contamination

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, named = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(named) == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    ids = lambda df: {r["doc_id"] for r in df.collect()}

    def stage(name, before):
        out = written(named[name](spark, before, SF), name)
        assert name == "tokens" or out.columns == columns
        return out

    clean = stage("toxicity", docs)
    bad = ids(toxicity.scored(docs, queries.toxicity_model(spark, docs, SF)).where("predicted = 1"))
    assert ids(clean) == ids(docs) - bad
    single = stage("near_dedup", clean)
    assert ids(single) == {c for _, c, _ in classes([(r["doc_id"], r["text"]) for r in clean.collect()])}
    rest = stage("decontamination", single)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(rest) == {k for k, *_, hit, _ in brute_contamination([(r["doc_id"], r["text"]) for r in single.collect()], items) if not hit}
    mixed = stage("mixing", rest)
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in mixing.mixed(rest).collect())
    out = stage("tokens", mixed)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out.collect()), key=repr) == brute_tokens([(r["doc_id"], r["text"]) for r in mixed.collect()])


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_null_ids_are_judged_by_their_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(2).collect()]
    odd = spark.createDataFrame([(None, x, None, None, None) for x in (items[0], items[1], "fine words", "fine words", None, "")] + [(900, "other words", None, None, None)], docs.schema)
    named = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r["text"] for r in df.collect()), key=repr)
    assert texts(named["decontamination"](spark, odd, SF)) == sorted(["fine words", "fine words", None, "", "other words"], key=repr)
    single = named["near_dedup"](spark, odd, SF)
    assert single.columns == docs.columns
    assert sorted(t or "" for t in texts(single)) == sorted([items[0], items[1], "fine words", "", "other words"])  # one row of each group
    assert named["toxicity"](spark, odd, SF).count() <= 7 and named["mixing"](spark, odd, SF).columns == docs.columns
    assert named["tokens"](spark, odd, SF).count() == 7
