"""Columns of the input that are called like the operators' own, and broadcasts that are checked by rows and bytes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seqweave.llm import _common, exact_dedup
from seqweave.llm._common import fits, free_names, without, written
from seqweave.llm.decontaminate import decontaminated
from seqweave.llm.exact_dedup import exact_duplicates
from seqweave.llm.mixing import mixed
from seqweave.llm.near_dedup import deduplicated

OWN = "__key __key1 __source __plan __place __hash __name __named __own __salt __times __rows __again __large KEY own row node kept n".split()


@pytest.fixture(scope="module")
def docs(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(words) for _ in range(30)), f"s{k % 3}") for k in range(40)] + [(40, "one two three four five six seven eight nine ten", "s0"), (41, "alpha beta", "s1"), (42, "alpha beta", "s1"), (None, "x", None), (None, "x", None)]
    out = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return out.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in OWN))


def unchanged(out, docs):
    assert out.columns[: len(docs.columns)] == docs.columns
    for r in out.collect():
        assert all(r[c] == f"{c} of {'?' if r['doc_id'] is None else r['doc_id']}" for c in OWN)


def test_filters_leave_columns_alone(spark, docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    kept = decontaminated(docs, items)
    unchanged(kept, docs)
    assert kept.count() == docs.count() - 1
    single = deduplicated(docs)
    unchanged(single, docs)
    assert single.count() == docs.count() - 2
    gone = without(docs, "doc_id", "text", lambda keyed, key: keyed.where("doc_id < 5").select(key))
    unchanged(gone, docs)
    assert gone.count() == docs.count() - 5


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_mixing_leaves_columns_alone(docs, monkeypatch, broadcast):
    from seqweave.llm import mixing

    monkeypatch.setattr(mixing, "BROADCAST", broadcast)
    monkeypatch.setattr(_common, "BROADCAST", broadcast)
    out = mixed(docs)
    unchanged(out, docs)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]


def test_free_names(docs):
    assert free_names(docs, "key", "source", "key", "fresh") == ["__key2", "__source1", "__key3", "__fresh"]


def test_broadcasts_are_checked_by_bytes(spark, monkeypatch):
    table = written(spark.createDataFrame([(1, "x" * 1000, [1, 2, 3]), (2, None, None)], "a long, b string, c array<long>"), "small")
    assert fits(table) and fits(table, 2) and not fits(table, 1) and fits(written(table.where("false"), "none"))
    monkeypatch.setattr(_common, "BROADCAST_BYTES", 1000)
    assert not fits(table) and fits(table.drop("b"))


def test_recipes_whose_digests_collide_are_told_apart(spark):
    texts = ["a" * n for n in range(1, 30)] * 2
    out = exact_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hash_bits=1).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in out} == {(k, max(i for i, t in enumerate(texts) if t == x), 2) for k, x in enumerate(texts)}


@pytest.mark.parametrize("letters", [range(0x4E00, 0x9FA0), range(0x430, 0x450), range(0x3B1, 0x3CA), range(0x621, 0x64B), range(0x905, 0x93A), range(0xAC00, 0xD7A0), range(0x3041, 0x3097), range(0xE01, 0xE2F), range(0x1F300, 0x1F650), range(0x20000, 0x2A000)])
def test_an_insertion_leaves_most_chunks_alone(spark, letters):
    """Texts of any script: after two characters are put before a text, nine of ten chunks are the same."""
    r = random.Random(4)
    text = "".join(chr(r.choice(letters)) for _ in range(40_000))
    one, two = ((x["c"]) for x in spark.createDataFrame([(1, text), (2, chr(letters[3]) * 2 + text)], "k int, t string").orderBy("k").select(exact_dedup.chunks(F.col("t")).alias("c")).collect())
    assert "".join(one) == text and len(set(one) & set(two)) >= 0.9 * len(one) and len(one) > 20
