from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from seqweave.operators import index, kmers, superkmers

from . import model


def brute(reads: dict, k: int) -> Counter:
    return Counter(c for s in reads.values() for c in model.codes(s, k) if c is not None)


def odd_reads(seed: int) -> dict:
    r = random.Random(seed)
    out = model.random_reads(seed, 40, 120)
    extra = ["A" * 900, "ACGT" * 200, "AC" * 300 + "N" + "GT" * 300, None, "", "ACG", "N" * 60, "acgtnACGT" * 30, "".join(r.choice("ACGT") for _ in range(3000))]
    return out | {1000 + i: s for i, s in enumerate(extra)}


@pytest.mark.parametrize("k", [1, 2, 7, 12, 13, 31])
def test_counts_equal_counting_each_kmer(spark, k):
    reads = odd_reads(k)
    want = brute(reads, k)
    frame = model.frame(spark, reads).repartition(3)
    assert {r["kmer"]: r["count"] for r in superkmers.kmer_counts(frame, k).collect()} == want
    assert superkmers.kmer_counts(frame, k).count() == len(want)
    assert {r["kmer"]: r["count"] for r in index.kmer_counts(frame, k, 3).collect()} == {c: n for c, n in want.items() if n >= 3}
    assert {r["abundance"]: r["kmers"] for r in superkmers.spectrum(frame, k).collect()} == Counter(want.values())


def test_large_buckets_are_counted_in_parts(spark, monkeypatch):
    """Chunks of few bases, and buckets of more k-mers than a task may hold: some counts come in parts and are added up."""
    reads = odd_reads(5)
    monkeypatch.setattr(superkmers, "CHUNK", 64)
    monkeypatch.setattr(superkmers, "BUCKETS", 64)
    monkeypatch.setattr(superkmers, "HELD", 100)
    monkeypatch.setattr(superkmers, "DISTINCT", 3)
    frame = model.frame(spark, reads).repartition(4)
    assert superkmers.counted(frame, 13).where("not whole").count() > 100
    want = brute(reads, 13)
    assert {r["kmer"]: r["count"] for r in superkmers.kmer_counts(frame, 13, 2).collect()} == {c: n for c, n in want.items() if n >= 2}
    assert {r["abundance"]: r["kmers"] for r in superkmers.spectrum(frame, 13).collect()} == Counter(want.values())


def test_a_kmer_and_its_reverse_complement_have_one_minimizer():
    r = random.Random(1)
    for _ in range(200):
        s = "".join(r.choice("ACGT") for _ in range(31))
        low = [int(superkmers.minimizers(np.frombuffer(x.encode(), np.uint8), 31, 11)[0]) for x in (s, model.rc(s))]
        assert low[0] == low[1] < 1 << 57


def test_packing_is_reversible():
    codes = np.random.default_rng(0).integers(0, 4, 4 * 1000).astype(np.uint8)
    assert (superkmers.unpacked(superkmers.packed(codes)) == codes).all() and len(superkmers.packed(codes)) == 1000


def test_the_shuffle_is_a_third_at_most(spark):
    """Bytes of the packed rows against those of k-mers with counts after the map side has combined them."""
    r = random.Random(3)
    reads = {i: "".join(r.choice("ACGT") for _ in range(20_000)) for i in range(20)}
    frame = model.frame(spark, reads)
    packed = sum(len(x["sizes"]) + len(x["bases"]) + 4 for x in superkmers.super_kmers(frame, 31).select("sizes", "bases").collect())
    assert packed < len(brute(reads, 31)) * 16 / 3


def test_an_empty_table(spark):
    assert superkmers.kmer_counts(model.frame(spark, {0: None}), 31).count() == 0 and superkmers.spectrum(model.frame(spark, {0: "ACG"}), 31).count() == 0


def test_short_kmers_are_counted_without_a_shuffle_of_reads(spark):
    reads = model.frame(spark, model.random_reads(5) | {900: None, 901: "", 902: "ACGNNACGTACGTTGCA"})
    for k in (1, 4, 7, 9):
        want = kmers.kmers(reads, k).where("kmer is not null").groupBy("kmer").count()
        assert sorted(map(tuple, superkmers.kmer_counts(reads, k).collect())) == sorted(map(tuple, want.collect()))
    assert "bases" not in superkmers.counted(reads, 7)._jdf.queryExecution().analyzed().toString()


def test_a_bucket_in_work_stays_small():
    # 6 GB of bases over the buckets: a task holds one and expands a part of it
    assert 6 * 10**9 / superkmers.BUCKETS < superkmers.DISTINCT and superkmers.CHUNK + superkmers.DISTINCT < 1 << 22
