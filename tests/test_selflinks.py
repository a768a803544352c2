from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from seqweave.operators import index, linker, membership, selflinks, superkmers

from . import model


def some_reads(seed: int, n: int = 60) -> dict:
    """Families of reads with errors, reverse complements, copies (some in lower case), a line that many share, reads with N, short and empty ones."""
    r = random.Random(seed)
    letter = lambda m: "".join(r.choice("ACGT") for _ in range(m))
    line, out = letter(40), {}
    families = [letter(r.randint(30, 160)) for _ in range(8)]
    for i in range(n):
        s = list(r.choice(families))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            s[r.randrange(len(s))] = r.choice("ACGTN")
        t = "".join(s)
        if r.random() < 0.3:
            t = model.rc(t)
        if r.random() < 0.3:
            at = r.randrange(len(t) + 1)
            t = t[:at] + line + t[at:]
        out[i] = t.lower() if r.random() < 0.2 else t
    out |= {n: "", n + 1: None, n + 2: "ACG", n + 3: line, n + 4: line, n + 5: "A" * 80, n + 6: "A" * 60, n + 7: "N" * 40, n + 8: letter(200), n + 9: out[0], n + 10: out[0]}
    return out


def brute(reads: dict, k: int, threshold: float) -> dict:
    """(query, target) to (span, pct) of all pairs of different reads, copies too."""
    out = {}
    codes = {i: model.codes(s, k) for i, s in reads.items()}
    for q, own in codes.items():
        n = len(reads[q] or "")
        for t, other in codes.items():
            if q == t or not n:
                continue
            known = {c for c in other if c is not None}
            span = sum(model.covered([p for p, c in enumerate(own) if c in known], n, k))
            if span and model.f32(100 * span / n) >= model.f32(threshold):
                out[q, t] = (span, model.f32(100 * span / n))
    return out


def expanded(spark, reads: dict, k: int, threshold: float):
    found = selflinks.self_links(model.frame(spark, reads), k, threshold)
    members: dict = {}
    for r in found.members.collect():
        members.setdefault(r["node"], []).append(r["read_id"])
    pairs = {(q, t): (r["span"], r["pct"]) for r in found.pairs.collect() for q in members[r["query"]] for t in members[r["target"]]}
    for r in found.classes.collect():  # the reads of a class link to one another by their own k-mers
        n, own = r["n"], r["own"]
        if n and own and model.f32(100 * own / n) >= model.f32(threshold):
            pairs |= {(q, t): (own, model.f32(100 * own / n)) for q in members[r["node"]] for t in members[r["node"]] if q != t}
    counts = {r["read_id"]: r["n_links"] for r in found.counts(threshold).collect()}
    return pairs, counts, members


@pytest.mark.parametrize(("seed", "k", "threshold"), [(1, 11, 75), (2, 11, 30), (3, 15, 95), (4, 7, 100), (5, 11, 1)])
def test_against_brute_force(spark, seed, k, threshold):
    reads = some_reads(seed)
    want = brute(reads, k, threshold)
    pairs, counts, members = expanded(spark, reads, k, threshold)
    assert pairs == want and want
    assert counts == {i: sum(q == i for q, _ in want) for i in reads}
    assert sorted(sorted(x) for x in members.values()) == sorted(sorted(i for i, s in reads.items() if (s or "").upper() == u) for u in {(s or "").upper() for s in reads.values()})


def test_hot_kmers_in_parts_and_small_blocks(spark, monkeypatch):
    """Postings dealt into parts of three, blocks of two reads, every k-mer hot: the same links."""
    for name, value in (("SPLIT", 3), ("BLOCK", 2), ("HOT", 1)):
        monkeypatch.setattr(selflinks, name, value)
    reads = some_reads(7)
    pairs, counts, _ = expanded(spark, reads, 11, 60)
    assert pairs == brute(reads, 11, 60)


def test_without_filters(spark, monkeypatch):
    """Where the k-mers are too many for a filter, the joins alone decide."""
    monkeypatch.setattr(selflinks, "membership", lambda table: None)
    reads = some_reads(8, 30)
    assert expanded(spark, reads, 11, 60)[0] == brute(reads, 11, 60)


def test_the_same_links_as_the_linker(spark):
    reads = model.frame(spark, some_reads(9))
    want = {(r["query_id"], r["target_id"], r["span"]) for r in linker.without_self(linker.links(reads, index.linker_index(reads, 11, 1, True), 75, keep_low_complexity=True)).collect()}
    pairs, _, _ = expanded(spark, some_reads(9), 11, 75)
    assert {(q, t, span) for (q, t), (span, _) in pairs.items()} == want


def test_empty_sets_and_thresholds(spark):
    assert selflinks.self_links(model.frame(spark, {}), 11).counts(75).count() == 0
    assert selflinks.self_links(model.frame(spark, {0: None, 1: "AC"}), 11).pairs.count() == 0
    with pytest.raises(ValueError):
        selflinks.self_links(model.frame(spark, {}), 11, 0)


def test_least_span():
    for threshold in (1, 33.3, 75, 99.9, 100):
        n = np.arange(1, 3000)
        got = selflinks.least_span(n, threshold)
        f32 = lambda s: (100 * s / n).astype(np.float32)
        assert (f32(got) >= np.float32(threshold)).all() and (f32(got - 1) < np.float32(threshold)).all()


def test_a_stretch_is_met_by_every_cover_that_is_large_enough():
    """Every set of shared places that leaves few bases uncovered has one in the stretch, wherever the costs put it."""
    r = random.Random(2)
    for _ in range(3000):
        k, n = r.randint(1, 5), r.randint(5, 16)
        cost = np.array([r.choice([0, 1, 5]) for _ in range(n - k + 1)])
        shared = [p for p in range(n - k + 1) if r.random() < r.choice([0.2, 0.6])]
        free = n - sum(model.covered(shared, n, k))
        low, high = selflinks.stretch(cost, free, k)
        assert not shared or any(low <= p < high for p in shared)
        assert cost[low:high].sum() <= cost.sum()


def test_the_rarest_places_are_met_by_every_cover_that_is_large_enough():
    r = random.Random(3)
    for _ in range(3000):
        k, n = r.randint(1, 5), r.randint(5, 16)
        cost = np.array([r.choice([0, 1, 16, 256]) for _ in range(n - k + 1)])
        least = r.randint(1, n)
        asked = selflinks.rarest(cost, least, k)
        shared = [p for p in np.flatnonzero(cost).tolist() if r.random() < 0.7]
        assert (cost[asked] > 0).all()
        assert sum(model.covered(shared, n, k)) < least or set(asked.tolist()) & set(shared)


def test_lines_that_cover_too_little_cost_few_pairs(spark, monkeypatch):
    """Reads of their own text between eight lines that all have: no stretch is without a line, but the lines cover too little. Only where the filter errs on a read's own k-mers are any of the 9,900 pairs compared."""
    own, rows = selflinks.written, {}

    def counted(df, name):
        out = own(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(selflinks, "written", counted)
    r = random.Random(8)
    letter = lambda m: "".join(r.choice("ACGT") for _ in range(m))
    lines = [letter(40) for _ in range(8)]
    reads = {i: "".join(letter(40) + line for line in lines) for i in range(100)}
    found = selflinks.self_links(model.frame(spark, reads), 31, 75)
    assert rows["pairs"] < 1000 and found.pairs.count() == 0


def test_a_kmer_that_a_read_repeats_is_its_own(spark):
    """Counted once a read, the k-mers of a tandem repeat are those of no other read."""
    reads = model.frame(spark, {0: "ACGTTGCA" * 40, 1: "GATTACAGG" * 30 + "ACGTTGCAACGTTGC", 2: None})
    assert superkmers.kmer_counts(reads, 11, 2).count() > 0
    assert {r["count"] for r in superkmers.kmer_counts(reads, 11, 1, once=True).collect()} <= {1, 2}
    assert superkmers.kmer_counts(reads, 5, 3, once=True).count() == 0


def test_a_line_that_thousands_share_costs_no_pairs(spark):
    """Ten thousand reads that share a line of 60 bases and nothing else: their own k-mers are looked up, not the line's, and no pair is compared."""
    r = random.Random(5)
    line = "".join(r.choice("ACGT") for _ in range(60))
    rows = [("", i, f"r{i}", "".join(r.choice("ACGT") for _ in range(90)) + line + "".join(r.choice("ACGT") for _ in range(90)), None) for i in range(10_000)]
    found = selflinks.self_links(spark.createDataFrame(rows, "read_set string, read_id long, header string, seq string, qual string"), 31, 75)
    assert found.pairs.count() == 0 and found.members.count() == 10_000


def test_membership_misses_no_kmer(spark, monkeypatch):
    r = random.Random(6)
    kmers, others = ({r.randrange(1 << 62) for _ in range(20_000)} for _ in range(2))
    table = spark.createDataFrame([(x,) for x in kmers], "kmer long")
    for shard in (1 << 17, 100):
        monkeypatch.setattr(membership, "SHARD", shard)
        test = membership.membership(table).test()
        assert test(np.array(sorted(kmers))).all()
        assert test(np.array(sorted(others - kmers))).mean() < 0.06
    assert membership.membership(table, most_bytes=1000) is None
    assert not membership.membership(table.where("false")).test()(np.arange(1000)).any()


def in_process(reads: dict, k: int, parts: int = 3) -> dict:
    """(read, place) to (colour, reads, first) of the shared k-mers, by the kernels alone, and the number of runs; runs as they leave their stretch."""
    m, table = min(superkmers.MINIMIZER, k), pa.table({"node": pa.array(list(reads), pa.int64()), "seq": pa.array([s.upper() for s in reads.values()])})
    made = pa.Table.from_batches(list(selflinks._stretches(k, m, 8)(iter(table.to_batches(max_chunksize=7)))))
    made = made.take(pa.array(np.argsort(made.column("bucket").to_numpy(), kind="stable"))).combine_chunks()
    out, runs = {}, 0
    for batch in selflinks._runs(k, m, parts, 0, 64)(iter(made.to_batches(max_chunksize=5))):
        rows = batch.filter(pa.compute.equal(batch.column("kind"), 1))
        whole = {c: selflinks._whole(rows.column(c)).tolist() for c in ("node", "start", "reads", "first")}
        length, colour = (selflinks._joined(rows.column(c), t).tolist() for c, t in (("length", np.uint8), ("colour", np.uint64)))
        runs += len(length)
        for i, n in enumerate(length):
            for place in range(whole["start"][i], whole["start"][i] + n):
                assert (whole["node"][i], place) not in out
                out[whole["node"][i], place] = (colour[i], whole["reads"][i], whole["first"][i])
    return out, runs


def test_colours_are_the_sets_of_reads_that_have_a_kmer(monkeypatch):
    """In pieces and passes of any size, with tandem repeats and minimizers that a stretch has twice, two k-mers have one colour just if the same reads have them."""
    r = random.Random(11)
    for k, seed in ((11, 1), (31, 2), (24, 3)):
        reads = {i: s or "" for i, s in some_reads(seed, 30).items()}
        unit = "".join(r.choice("ACGT") for _ in range(23))
        reads |= {100: unit * 6, 101: model.rc(unit * 5), 102: "A" * 50 + unit * 3, 103: (unit[:12] * 8)[5:], 104: "C" + (unit[:12] * 7)}
        having: dict = {}
        for i, s in reads.items():
            for c in model.codes(s, k):
                having.setdefault(c, set()).add(i)
        want = {(i, p): having[c] for i, s in reads.items() for p, c in enumerate(model.codes(s, k)) if c is not None and len(having[c]) > 1}
        for small in (False, True):
            if small:
                for name, value in (("STRETCHES", 50), ("PIECE", 100), ("KMERS", 64), ("RUNS", 20), ("NEAR", 300)):
                    monkeypatch.setattr(selflinks, name, value)
            found, _ = in_process(reads, k)
            assert found.keys() == want.keys()
            assert all(found[x][1:] == (len(want[x]), min(want[x])) for x in want)
            names = {(found[x][0], frozenset(want[x])) for x in want}
            assert len(names) == len({a for a, _ in names}) == len({b for _, b in names})
        monkeypatch.undo()


def test_near_copies_move_as_few_runs():
    """Two hundred copies of a text with a base changed in each: what is left of 394,000 k-mers are runs, one for each stretch that an edit cuts."""
    r = random.Random(12)
    text = "".join(r.choice("ACGT") for _ in range(2000))
    reads = {i: text[: 10 * i] + r.choice("ACGT") + text[10 * i + 1 :] for i in range(200)}
    found, runs = in_process(reads, 31)
    assert len(found) > 380_000 and runs < len(found) / 4


def test_stretches_of_their_own_fall_out():
    r = random.Random(13)
    reads = {i: "".join(r.choice("ACGT") for _ in range(3000)) for i in range(20)}
    made = pa.Table.from_batches(list(selflinks._stretches(31, 11, 1)(iter(pa.table({"node": pa.array(list(reads), pa.int64()), "seq": list(reads.values())}).to_batches()))))
    rows = made.filter(pa.compute.greater_equal(made.column("bucket"), 0)).combine_chunks().to_batches()[0]
    anchor, sizes, bases = (selflinks._joined(rows.column(c), np.uint8) for c in ("anchor", "sizes", "bases"))
    filled = -(-sizes.astype(np.int64) // 4) * 4
    keep = selflinks.may_share(anchor, sizes, superkmers.unpacked(bases), np.cumsum(filled) - filled, 31, 11)
    assert len(keep) > 3000 and keep.mean() < 0.3


def test_names_that_clash_are_made_anew(spark, monkeypatch):
    """Where two sets of reads have one name of four bits, all get names of 64; links are never made by a name alone."""
    reads = some_reads(14, 40)
    monkeypatch.setattr(selflinks, "BITS", (4, 64))
    assert expanded(spark, reads, 11, 60)[0] == brute(reads, 11, 60)
    monkeypatch.setattr(selflinks, "BITS", (4,))
    with pytest.raises(RuntimeError):
        selflinks.self_links(model.frame(spark, reads), 11, 60)


def test_numbers_travel_whole():
    r = random.Random(15)
    for most in (200, 60_000, 1 << 31):
        for size in (1, 5, 3000):
            x = np.unique(np.array([r.randrange(most) for _ in range(size)]))
            assert (selflinks.unpacked_numbers(selflinks.packed_numbers(x)) == x).all()
    x = np.array([r.randrange(1 << 32) for _ in range(100)], np.uint32)
    column = selflinks._planes(x, np.array([0, 3, 3, 60, 100]))
    assert (selflinks._whole(column) == x).all() and (selflinks._whole(column.slice(2, 2)) == x[3:]).all()


def test_spans_of_targets_in_parts(monkeypatch):
    """However few targets are looked at together, by a table or by lists, a query's spans are those of the places it shares with each."""
    r = random.Random(16)
    k, colours = 5, 12
    having = [sorted(r.sample(range(40), r.randint(2, 30))) for _ in range(colours)]
    start, length, at = [], [], 0
    for _ in range(25):
        at += r.choice([0, 0, 1, 9])
        start.append(at)
        length.append(r.randint(1, 4))
        at += length[-1]
    start, length, which = np.array(start), np.array(length), np.array([r.randrange(colours) for _ in start])
    asked = np.array([c < 4 for c in range(colours)])
    for cells, table in ((1 << 20, 0), (30, 0), (1 << 20, 1 << 20), (30, 1 << 20)):
        monkeypatch.setattr(selflinks, "CELLS", cells)
        monkeypatch.setattr(selflinks, "TABLE", table)
        targets = selflinks._Targets([(c, selflinks.packed_numbers(np.array(having[c]))) for c in range(4)])
        for c in range(4, colours):
            targets.add(c, selflinks.packed_numbers(np.array(having[c])))
        nodes, spans = targets.spans(7, start, length, which, list(range(colours)), asked, k)
        assert nodes.tolist() == sorted({t for c in range(4) for t in having[c]} - {7})
        for t, span in zip(nodes.tolist(), spans.tolist(), strict=True):
            places = [p for a, n, c in zip(start.tolist(), length.tolist(), which.tolist(), strict=True) if t in having[c] for p in range(a, a + n)]
            assert span == sum(model.covered(places, at + k, k))
