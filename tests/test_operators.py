from __future__ import annotations

import random
import statistics

import numpy as np
import pyarrow as pa
import pytest

from seqweave.operators import complexity, counter, coverage, index, kmers, linker, readsets, runs

from . import model as m

K = 11


@pytest.fixture(scope="module")
def bank():
    return m.random_reads(1)


@pytest.fixture(scope="module")
def queries(bank):
    return m.random_reads(1, 30) | {100: bank[0], 101: m.rc(bank[1].upper()), 102: "ACGTN" * 10}


@pytest.mark.parametrize("k", [1, 2, 7, 16, 31])
def test_kmers_match_the_model(spark, queries, k):
    frame = m.frame(spark, queries)
    want = {(i, p): c for i, s in queries.items() for p, c in enumerate(m.codes(s, k))}
    for got in (kmers.kmers(frame, k), kmers.kmers_builtin(frame, k, 16)):
        rows = got.collect()
        assert {(r["read_id"], r["pos"]): r["kmer"] for r in rows} == want and len(rows) == len(want)


def test_null_and_empty_reads_have_no_kmers(spark):
    frame = spark.createDataFrame([("", 1, None), ("", 2, ""), (None, None, "ACGT")], "read_set string, read_id long, seq string")
    assert [(r["read_id"], r["kmer"]) for r in kmers.kmers(frame, 4).collect()] == [(None, m.code("ACGT"))]
    assert kmers.kmers(frame.where("false"), 4).count() == 0


def test_k_is_bounded(spark, bank):
    with pytest.raises(ValueError):
        kmers.kmers(m.frame(spark, bank), 32)


@pytest.mark.parametrize(("threshold", "window", "a", "keep", "z"), [(75, 0, 1, True, 0), (30, 0, 2, True, 0), (50, 15, 1, True, 0), (60, 200, 2, False, 0), (1, 0, 1, True, 20), (80, 30, 1, False, 25)])
def test_links_match_the_model(spark, bank, queries, threshold, window, a, keep, z):
    made = index.linker_index(m.frame(spark, bank), K, a, keep)
    got = linker.links(m.frame(spark, queries), made, threshold, window, keep, z, 40).collect()
    want = m.links(queries, bank, K, a, threshold, window, keep, z, 40)
    assert {(r["query_id"], r["target_id"]): (r["span"], r["pct"]) for r in got} == want and want
    ids = linker.linked_ids(m.frame(spark, queries), made, threshold, window=window, keep_low_complexity=keep, zero_window=z, zero_threshold=40).collect()
    best: dict[int, float] = {}
    for (q, _), (_, pct) in want.items():
        best[q] = max(pct, best.get(q, 0))
    assert {r["query_id"]: r["max_pct"] for r in ids} == {q: int(p) for q, p in best.items()}


def test_links_by_any_kmer_override_windows(spark, bank, queries):
    made = index.linker_index(m.frame(spark, bank), K, 1, True)
    got = linker.links_for(m.frame(spark, queries), made, 0, window=3, keep_low_complexity=True, zero_window=5)
    assert {(r["query_id"], r["target_id"]) for r in got.collect()} == set(m.links(queries, bank, K, 1, 1e-9))


def test_a_read_links_to_itself_and_its_reverse(spark, bank):
    whole = {i: s.upper() for i, s in bank.items() if len(s) >= K and "N" not in s.upper()}
    made = index.linker_index(m.frame(spark, whole), K, 1, True)
    straight = {(r["query_id"], r["target_id"]): r["span"] for r in linker.links(m.frame(spark, whole), made, 100, keep_low_complexity=True).collect()}
    turned = {(r["query_id"], r["target_id"]): r["span"] for r in linker.links(m.frame(spark, {i: m.rc(s) for i, s in whole.items()}), made, 100, keep_low_complexity=True).collect()}
    assert straight == turned and all(straight[i, i] == len(s) for i, s in whole.items())


def test_read_sets_stay_apart(spark, bank, queries):
    made = index.linker_index(m.frame(spark, bank), K, 1, True)
    two = m.frame(spark, queries, "x").union(m.frame(spark, {0: queries[1]}, "y"))
    got = linker.links(two, made, 75, keep_low_complexity=True).collect()
    assert {(r["query_id"], r["target_id"]) for r in got if r["read_set"] == "x"} == set(m.links(queries, bank, K, 1, 75))
    assert {r["target_id"] for r in got if r["read_set"] == "y"} == {t for q, t in m.links(queries, bank, K, 1, 75) if q == 1}


@pytest.mark.parametrize(("threshold", "window"), [(0, 0), (50, 0), (40, 20)])
def test_counts_match_the_model(spark, bank, queries, threshold, window):
    solid: dict[int, int] = {}
    for s in bank.values():
        for c in m.codes(s, K):
            solid[c] = solid.get(c, 0) + 1
    want = {}
    for q, s in queries.items():
        values = [min(solid.get(c, 0), 255) if c is not None and solid.get(c, 0) >= 2 else 0 for c in m.codes(s, K)]
        if not values:
            want[q] = (None,) * 5
            continue
        w = len(s) if window <= 0 or window > len(s) else window
        pct = m.f32(100 * m.best_window(m.covered([p for p, v in enumerate(values) if v], len(s), K), w) / w)
        if pct >= threshold:
            want[q] = (m.f32(sum(values) / len(values)), statistics.median_high(values), min(values), max(values), pct)
    made = index.counter_index(m.frame(spark, bank), K, 2)
    got = counter.counts(m.frame(spark, queries), made, threshold, window, True).collect()
    assert {r["query_id"]: tuple(r)[2:] for r in got} == want
    assert {r["query_id"] for r in counter.counts(m.frame(spark, queries), made, threshold, window).collect()} == {q for q, v in want.items() if v[0] is not None and m.complex_(queries[q], K)}
    assert {r["query_id"] for r in counter.mean_between(counter.counts(m.frame(spark, queries), made, 0, 0, True), 0.5, 2).collect()} <= set(queries)


def test_abundance_stops_at_255_and_solidity_counts_all_reads(spark):
    frame = m.frame(spark, {i: "ACGTACGGTCA" for i in range(300)} | {900: "TTTTTTTTTTT"})
    assert [tuple(r) for r in index.solid_kmers(frame, K, 2).collect()] == [(m.code("ACGTACGGTCA"), 255)]
    assert {r["abundance"]: r["kmers"] for r in index.kmer_spectrum(frame, K).collect()} == {300: 1, 1: 1}
    with pytest.raises(index.NoSolidKmers):
        index.linker_index(frame, K, 301).checked()


def test_complexity_matches_the_model(spark, queries):
    reads = queries | {200 + n: ("ACGGTCATTGCAAC" * 9)[:n] for n in range(2, 60)}
    assert {r["read_id"] for r in complexity.complex_reads(m.frame(spark, reads), 2).collect()} == {i for i, s in reads.items() if m.complex_(s, 2)}
    bounds = {r["n"]: r["b"] for r in spark.range(2, 101).selectExpr("cast(id as int) n").withColumn("b", complexity.dust_bound(__import__("pyspark").sql.functions.col("n"))).collect()}
    assert [bounds[n] for n in (2, 9, 10, 31, 100)] == [0, 0, 1, 21, 282]


def test_index_round_trip(spark, bank, tmp_path):
    made = index.linker_index(m.frame(spark, bank), K, 2, True)
    made.save(str(tmp_path / "x"), 3)
    back = index.load_index(spark, str(tmp_path / "x"))
    assert (back.k, back.abundance_min, back.keep_low_complexity, back.kind) == (K, 2, True, "linker")
    assert sorted(map(tuple, back.table.collect())) == sorted(map(tuple, made.table.collect()))


def test_repeated_kmers(spark):
    got = kmers.repeated_kmers(kmers.kmers(m.frame(spark, {0: "ACGTTACGTT", 1: "ACGGTCATTG", 2: "NNNNNNNNNN"}), 5))
    assert [r["read_id"] for r in got.collect()] == [0]


def test_sets_and_vector_files(spark, tmp_path, monkeypatch):
    make = lambda ids: spark.createDataFrame([("s", i) for i in ids], "read_set string, read_id long")
    a, b = make([0, 3, 64, 70, 99]), make([3, 4, 99])
    ids = lambda df: sorted(r["read_id"] for r in df.collect())
    assert ids(readsets.both(a, b)) == [3, 99] and ids(readsets.either(a, b)) == [0, 3, 4, 64, 70, 99] and ids(readsets.minus(a, b)) == [0, 64, 70]
    assert ids(readsets.complement(b, make(range(6)))) == [0, 1, 2, 5]
    assert readsets.cardinality(a).first()["ones"] == 5
    path = str(tmp_path / "v.bv")
    for chunk in (1 << 20, 16):
        monkeypatch.setattr(readsets, "CHUNK", chunk)
        for size, want in ((100, [0, 3, 64, 70, 99]), (65, [0, 3, 64]), (8, [0, 3]), (2000, [0, 3, 64, 70, 99])):
            readsets.write_vector(a, path, size, "made by a test")
            data = open(path, "rb").read()
            head = f"made by a test\n#{size}\n".encode()
            assert data.startswith(head) and len(data) == len(head) + size // 8 + 1 and data[len(head)] == 0b1001
            got = readsets.read_vector(spark, path, "s")
            assert (ids(got.ids), got.size, got.comment) == (want, size, "made by a test\n")
    readsets.write_vector(make([]), path, 0)
    assert open(path, "rb").read() == b"#0\n\0" and ids(readsets.read_vector(spark, path).ids) == []
    for text in (b"no size\n", b"#100\nshort"):
        open(path, "wb").write(text)
        with pytest.raises(ValueError):
            readsets.read_vector(spark, path)


def test_vectors(spark):
    numbers = lambda ids: spark.createDataFrame([(i,) for i in ids], "read_id long")
    ids = lambda v: sorted(r["read_id"] for r in v.ids.collect())
    none, every = readsets.Vector.of(spark, 6, read_set="s"), readsets.Vector.of(spark, 6, True, "s")
    some = none.set(numbers([1, 4, 4, 9, -1]))
    assert (ids(none), ids(every), ids(some)) == ([], list(range(6)), [1, 4])
    assert ids(~some) == [0, 2, 3, 5] and ids(every - some) == [0, 2, 3, 5] and ids(some | none) == [1, 4] and ids(some & every) == [1, 4]
    assert ids(some.reset(numbers([4, 5]))) == [1]
    assert sorted(tuple(r) for r in some.test(numbers([1, 2])).collect()) == [(1, True), (2, False)]
    for f in ("__and__", "__or__", "__sub__"):
        with pytest.raises(ValueError):
            getattr(some, f)(readsets.Vector.of(spark, 7))


def test_thresholds_of_vectors(spark):
    found = spark.createDataFrame([("s", 1, 5, 75.0), ("s", 1, 6, 10.0), ("s", 2, 5, 74.9)], "read_set string, query_id long, target_id long, pct float")
    assert [r["read_id"] for r in readsets.selected_by_links(found, 75).collect()] == [1]
    assert readsets.selected_by_counts(found, 75).count() == 0  # strictly more
    with pytest.raises(ValueError):
        readsets.selected_by_links(found.drop("pct"), 75)


@pytest.mark.parametrize("lines", [1 << 20, 2, 1])
def test_runs_are_neighbours_not_groups(spark, monkeypatch, lines):
    monkeypatch.setattr(runs, "LINES", lines)
    rows = [(0, "q", "a", 50.0), (1, "q", "a", 90.0), (2, "q", "b", 80.0), (3, "q", "a", 70.0), (4, "p", "a", 95.0), (5, "q", "a", 60.0), (9, "q", "a", 65.0), (14, "q", "a", 10.0)]
    frame = spark.createDataFrame([(n, q, t, p, 10, 10) for n, q, t, p in rows], "line_no long, qseqid string, sseqid string, pident double, length int, qlen int")
    got = sorted((r["run"], r["qseqid"], r["sseqid"], r["ratio"]) for r in runs.run_max(frame, 0).collect())
    assert got == [(0, "q", "a", 90.0), (2, "q", "b", 80.0), (3, "q", "a", 70.0), (4, "p", "a", 95.0), (5, "q", "a", 65.0)]
    assert runs.run_max(frame, 80).count() == 3 and runs.run_max(frame.where("false"), 0).count() == 0


@pytest.mark.parametrize("lines", [1 << 20, 3, 1])
def test_first_of_runs_and_uniform(spark, monkeypatch, lines):
    monkeypatch.setattr(runs, "LINES", lines)
    rows = [(0, 1, 1, 9), (1, 1, 2, 8), (2, 1, 2, 7), (3, 1, 3, 6), (4, 1, 2, 5), (5, 5, 3, 4), (6, 1, 2, 3), (7, 1, 1, 2), (20, 1, 2, 1)]
    frame = spark.createDataFrame(rows, "line_no long, query_id long, target_id long, span long")
    want, last = [], None
    for row in rows:
        if row[1] != row[2]:
            if row[1:3] != last:
                want.append(row)
            last = row[1:3]
    assert sorted(tuple(r) for r in runs.first_of_runs(frame).collect()) == want and len(want) == 5
    assert {r["query_id"]: r["targets"] for r in runs.uniform(frame).collect()} == {1: "1-2 2-1 3-6", 5: "3-4"}


def random_covers(r, rows):
    """(n, k, places of each read), the places in any order."""
    k = r.randint(1, 12)
    sizes = [r.randint(0, 60) for _ in range(rows)]
    return k, sizes, [r.sample(range(n - k + 1), r.randint(0, min(6, n - k + 1))) if n >= k else [] for n in sizes]


@pytest.mark.parametrize("seed", [1, 2])
def test_covers_of_many_reads_equal_covers_by_bases(seed):
    r = random.Random(seed)
    for _ in range(100):
        k, sizes, places = random_covers(r, r.randint(0, 9))
        cover = coverage.Covers(pa.array(places, pa.list_(pa.int32())), pa.array(sizes, pa.int32()), k)
        for i, (n, at) in enumerate(zip(sizes, places, strict=True)):
            bases = m.covered(at, max(n, k), k)[:n]
            w = r.randint(0, n)
            starts = np.arange(n - w + 1)
            got = cover.windows(np.full(len(starts), i), starts, np.full(len(starts), w))
            assert got.tolist() == [sum(bases[s : s + w]) for s in starts]


@pytest.mark.parametrize("window", [0, 1, 7, 25, 100])
def test_windows_of_a_batch_equal_the_model(spark, window):
    r = random.Random(window)
    k, sizes, places = random_covers(r, 200)
    rows = [(i, n, at) for i, (n, at) in enumerate(zip(sizes, places, strict=True))]
    table = spark.createDataFrame(rows, "id int, n int, positions array<int>").repartition(3)
    got = table.select("id", coverage.window_span(k, window)("positions", "n").alias("best"), coverage.sparse_window(k, max(window, 1), 40)("positions", "n").alias("sparse")).collect()
    for x in got:
        n, at = sizes[x["id"]], places[x["id"]]
        bases = m.covered(at, max(n, k), k)[:n]
        assert x["best"] == (m.best_window(bases, n if window <= 0 or window > n else window) if n else 0)
        assert x["sparse"] == (m.too_sparse(bases, max(window, 1), 40) if n else False)


def test_reads_of_a_hundred_million_bases(spark):
    """Costs follow the places, not the read."""
    n = 100_000_000
    rows = [(1, n, [0, 5, n // 2, n // 2 + 1000, n - 31]), (2, 50, [3])]
    got = spark.createDataFrame(rows, "id int, n int, positions array<int>").select("id", coverage.window_span(31, 2000)("positions", "n").alias("best"), coverage.sparse_window(31, 1000, 99)("positions", "n").alias("sparse")).orderBy("id").collect()
    assert [(x["best"], x["sparse"]) for x in got] == [(62, True), (31, False)]


def test_a_stored_index_stays_where_it_is(spark, tmp_path):
    """Queries of a stored index move their own k-mers only: no exchange above the index, and few of the k-mers that it lacks."""
    reads, queries = m.random_reads(31), m.random_reads(32) | {100 + i: s for i, s in m.random_reads(33).items()}
    made = index.linker_index(m.frame(spark, reads), 11, 1, True)
    made.save(f"{tmp_path}/x", 5)
    back = index.load_index(spark, f"{tmp_path}/x")
    assert back.known
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = kmers.kmers(m.frame(spark, queries), 11, back.known).where("kmer is not null").join(back.table, "kmer")
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") - plan.count("ReusedExchange") == 1, plan
    assert "SelectedBucketsCount: 5 out of 5" in plan
    every = kmers.kmers(m.frame(spark, queries), 11).where("kmer is not null")
    want = every.join(made.table, "kmer")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect()))
    probes, known = kmers.kmers(m.frame(spark, queries), 11, back.known).count(), every.join(made.table, "kmer", "left_semi").count()
    assert known <= probes <= known + 0.1 * (every.count() - known) < every.count()


def test_counts_by_a_stored_index_equal_those_by_a_planned_one(spark, tmp_path):
    made = index.counter_index(m.frame(spark, m.random_reads(34)), 11, 1)
    made.save(f"{tmp_path}/y", 3)
    back, queries = index.load_index(spark, f"{tmp_path}/y"), m.frame(spark, m.random_reads(35))
    for threshold in (0, 40):
        got, want = (sorted(map(tuple, counter.counts(queries, x, threshold, 20, True).collect()), key=repr) for x in (back, made))
        assert got == want and got


def test_runs_leave_columns_alone(spark):
    own = ["__was", "__part", "__carried", "__first"]
    rows = spark.createDataFrame([(i, 1 + i % 2, 5, 3, 0.5, 10, 20, *("a", "b", "c", "d")) for i in range(6)], f"line_no long, query_id long, target_id long, span long, pident double, length int, qlen int, {', '.join(c + ' string' for c in own)}")
    out = runs.first_of_runs(rows)
    assert out.columns == rows.columns and {tuple(r[c] for c in own) for r in out.collect()} == {("a", "b", "c", "d")}
    assert runs.run_max(rows, 0, "query_id", "target_id").count() == 6


def test_uniform_keeps_lines_apart(spark):
    rows = spark.createDataFrame([(1, 7, 0, 3, 30), (1, 7, 1, 2, 20), (2, 7, 0, 3, 9)], "line long, query_id long, place int, target_id long, span long")
    assert sorted((r["line"], r["targets"]) for r in runs.uniform(rows, "place", ("line", "query_id")).collect()) == [(1, "2-20 3-30"), (2, "3-9")]


@pytest.mark.parametrize(("a", "keep"), [(1, True), (2, True), (2, False)])
def test_an_index_for_known_queries_holds_their_kmers_only(spark, bank, queries, a, keep):
    asked = {i: s for i, s in queries.items() if i in (100, 101)}
    every = {(r["kmer"], r["target_id"]) for r in index.linker_index(m.frame(spark, bank), K, a, keep).table.collect()}
    made = index.linker_index(m.frame(spark, bank), K, a, keep, m.frame(spark, asked))
    got = [(r["kmer"], r["target_id"]) for r in made.table.collect()]
    own = {c for s in asked.values() for c in m.codes(s, K)}
    assert set(got) == {x for x in every if x[0] in own} and len(set(got)) == len(got) < len(every)
    found = linker.links(m.frame(spark, asked), made, 1, keep_low_complexity=keep).collect()
    assert {(r["query_id"], r["target_id"]): (r["span"], r["pct"]) for r in found} == m.links(asked, bank, K, a, 1, 0, keep, 0, 40)


def test_reads_with_repeats_need_no_shuffle_of_kmers(spark, queries):
    seqs = queries | {200: "ACGTTGCAACGGTACGTTGCAACGG", 201: "NNNNNNNNNNNNNNNNNNNNNNNN", 202: "ACG", 203: None}
    frame = m.frame(spark, seqs)
    twice = frame.union(frame.where(f"read_id in ({min(queries)}, 202)"))
    for reads in (frame, twice):
        want = {r["read_id"] for r in kmers.repeated_kmers(kmers.kmers(reads, K)).collect()}
        found = kmers.reads_with_repeats(reads, K)
        got = [r["read_id"] for r in found.collect()]
        assert sorted(got) == sorted(want) and 200 in want and 201 not in want
    assert "hashpartitioning(kmer" not in kmers.reads_with_repeats(frame, K)._jdf.queryExecution().executedPlan().toString()


def test_reads_without_kmers_are_told_without_counting(spark, bank, queries):
    seqs = queries | {200: "ACG", 201: "", 202: None}
    frame = m.frame(spark, seqs)
    every = counter.counts(frame, index.counter_index(m.frame(spark, bank), K, 1), 0, keep_low_complexity=True)
    own = counter.uncounted(frame, K)
    assert own.dtypes == every.dtypes
    want = every.where("mean is null").collect()
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want)) and {r["query_id"] for r in want} >= {200, 201, 202}
