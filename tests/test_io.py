from __future__ import annotations

import glob
import gzip

import pytest
from pyspark.sql import functions as F

from seqweave import cli, session
from seqweave.functions import sequences as sq
from seqweave.operators import counter, index, linker
from seqweave.plans import convert, formats
from seqweave.sources import reads, results
from seqweave.streaming.links import stream_links

from . import model as m


@pytest.fixture
def files(tmp_path):
    a = tmp_path / "a.fasta"
    a.write_text(">r0 first read\nACGTTGCAAC\nGGTCATTGCA\n\n>r1\nACGT\n")
    b = tmp_path / "b.fastq.gz"
    with gzip.open(b, "wt") as f:
        f.write("@q0 x\nACGTTGCAACGGTCATTGCA\n+\n" + "@" * 20 + "\n@q1\nTTTT\n+\nIIII\n")
    inner, fof = tmp_path / "inner.txt", tmp_path / "fof.txt"
    inner.write_text(f"{a}\n{b}\n")
    fof.write_text(f"# sets\n{a}\n{inner}\n")
    return str(a), str(b), str(fof), tmp_path


def test_readers(spark, files):
    a, b, fof, _ = files
    assert [tuple(r)[1:] for r in reads.read_bank(spark, a).orderBy("read_id").collect()] == [(0, "r0 first read", "ACGTTGCAACGGTCATTGCA", None), (1, "r1", "ACGT", None)]
    assert [(r["seq"], r["qual"]) for r in reads.read_bank(spark, b).orderBy("read_id").collect()] == [("ACGTTGCAACGGTCATTGCA", "@" * 20), ("TTTT", "IIII")]
    assert {(r["read_set"].rsplit("/", 1)[1], r["n"]) for r in reads.read_album(spark, fof).groupBy("read_set").agg(F.count("*").alias("n")).collect()} == {("a.fasta", 2), ("b.fastq.gz", 2)}
    with pytest.raises(ValueError):
        reads.read_bank(spark, fof)


def test_pieces_of_a_file(spark, tmp_path):
    path = tmp_path / "big.fa"
    path.write_bytes(b">r0 a>b\nAC\nGT\n>r1\n\n>r2\n" + b"ACGT\n" * 40 + b">r3\r\nTT\r\n>r4\nA")
    want = [(0, "r0 a>b", "ACGT"), (1, "r1", ""), (2, "r2", "ACGT" * 40), (3, "r3", "TT"), (4, "r4", "A")]
    for piece in (1, 2, 7, 50, 1000):
        got = reads.read_sets(spark, [("s", str(path))], piece)
        assert sorted(tuple(r) for r in got.select("read_id", "header", "seq").collect()) == want
    assert [tuple(r) for r in reads.count_reads(got).collect()] == [("s", 5)]


def test_shared_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_base", lambda _: "file://" + str(tmp_path))
    assert session.run_folder(spark).startswith(f"file://{tmp_path}/seqweave/")
    spark.range(3).write.parquet(session.run_folder(spark) + "/t")
    session.drop_tables(spark)
    assert (tmp_path / "seqweave").exists() and not (tmp_path / "seqweave" / spark.sparkContext.applicationId).exists()


def test_text_adapter(spark):
    frame = spark.createDataFrame([(1, "Abc, xyz! É"), (2, None)], "i long, t string")
    assert [r["seq"] for r in reads.text_reads(frame, F.col("i"), F.col("t")).orderBy("read_id").collect()] == ["ACCAAC", ""]


def test_functions(spark):
    row = spark.range(1).select(
        sq.reverse_complement(F.lit("AACG")).alias("rc"), sq.canonical(F.lit("TTT")).alias("c"), sq.canonical_code(F.lit("TTGAC")).alias("n"), sq.saturated(F.lit(300)).alias("s"),
        sq.effective_window(F.lit(10), 0).alias("w0"), sq.effective_window(F.lit(10), -3).alias("w1"), sq.effective_window(F.lit(10), 20).alias("w2"), sq.effective_window(F.lit(10), 4).alias("w3"),
        formats.six(sq.percentage(F.lit(77), F.lit(99))).alias("p"), sq.header_token(F.lit(">r1 x y")).alias("h"), sq.basename(F.lit("a/b\\c.fa")).alias("b"), sq.nucleotide_code(F.lit("N")).alias("N"),
        sq.suffix(F.lit("ACGT"), 2).alias("suffix"), sq.prefix(F.lit("ACGT"), 3).alias("prefix"), sq.aligned_ratio(F.lit(90.0), F.lit(10), F.lit(20)).alias("a"),
    ).first()
    assert tuple(row) == ("CGTT", "AAA", m.code("TTGAC"), 255, 10, 10, 10, 4, "77.777779", "r1", "c.fa", 3, "GT", "ACG", 45.0)


def _found(spark):
    return spark.createDataFrame([("s", 0, 2, 93, 93.0), ("s", 0, 0, 99, 100.0), ("s", 1, 2, 77, 77.77778)], "read_set string, query_id long, target_id long, span long, pct float")


def test_text_round_trips(spark):
    lines = formats.link_lines(_found(spark)).orderBy("query_id")
    assert [r["line"] for r in lines.collect()] == ["0:0-99-100.000000 2-93-93.000000 ", "1:2-77-77.777779 "]
    back = results.parse_links(lines.select(F.col("line").alias("value")).union(spark.createDataFrame([("# head",)], "value string")))
    assert sorted((r["query_id"], r["target_id"], r["span"], round(r["pct"], 3)) for r in back.collect()) == [(0, 0, 99, 100.0), (0, 2, 93, 93.0), (1, 2, 77, 77.778)]
    counts = spark.createDataFrame([("s", 0, 3.6142857, 4, 2, 5, 100.0), ("s", 1, None, None, None, None, None)], "read_set string, query_id long, mean float, median int, min int, max int, pct float")
    lines = formats.count_lines(counts).orderBy("query_id")
    assert [r["line"] for r in lines.collect()] == ["0 3.614286 4 2 5 100.000000", "1 none"]
    assert [(r["query_id"], r["median"], r["pct"]) for r in results.parse_counts(lines.select(F.col("line").alias("value"))).orderBy("query_id").collect()] == [(0, 4, 100.0), (1, None, None)]
    assert [tuple(r) for r in results.parse_link_ids(spark.createDataFrame([("7 93",)], "value string")).collect()] == [(7, 93)]
    any_ = results.parse_links(formats.any_link_lines(_found(spark)).select(F.col("line").alias("value")))
    assert sorted((r["query_id"], r["target_id"], r["span"]) for r in any_.collect()) == [(0, 0, None), (0, 2, None), (1, 2, None)]
    assert spark.range(1).select(results.read_set_of(formats.count_header(F.lit("x/c1.fa"), 31, "i")).alias("x")).first()["x"] == "x/c1.fa"


def test_conversions_and_graphs(spark, tmp_path):
    bank = m.frame(spark, {0: "ACGTTGCAACGGTCATTGCA", 1: "TTTTTGGGGGCCCCCAAAAA", 2: "GATTACAGATTACACATTAG"}, "s")
    found = _found(spark)
    assert sorted(r["read_id"] for r in convert.linked_reads(found, bank).collect()) == [0, 1]
    assert sorted(r["line"] for r in convert.header_pairs(found, bank, bank).collect()) == ["r0:r2-93-93.0 ", "r1:r2-77-77.78 "]
    assert [tuple(r)[:3] for r in convert.mosaic(found, bank, bank, 80).collect()] == [("r0", "r2", 0.0)]
    assert convert.read_pairs(found, bank, bank).count() == 2 and convert.vector_reads(found, bank, 90).count() == 1
    convert.write_mosaic(convert.mosaic(found, bank, bank), str(tmp_path / "mosaic"))
    assert spark.read.csv(str(tmp_path / "mosaic"), sep="\t", header=True).columns == ["qseqid", "sseqid", "evalue", "pident"]
    formats.write_dot(bank, found, str(tmp_path / "dot"), 5)
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "dot")).collect())
    assert '0 -> 2 [label="93.0"];' in text and "0 -> 0" not in text and '1[ label="r1_len_20_' in text
    formats.write_xgmml(bank, found, str(tmp_path / "xgmml"), 5)
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "xgmml")).collect())
    assert '<edge source="0" target="2" label="93.0">' in text and text.count("<node ") == 3
    counts = spark.createDataFrame([("s", 0, 3.5, 4, 2, 5, 100.0), ("s", 1, 0.5, 0, 0, 1, 10.0)], "read_set string, query_id long, mean float, median int, min int, max int, pct float")
    assert [r["header"] for r in convert.counted_reads(counts, bank, 1, 4).collect()] == ["r0_cov_3.500000_4_2_5_100.000000"]
    convert.write_well_covered(counts, bank, 50, str(tmp_path / "well"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "well/file=s")).collect()] == [">r0", "ACGTTGCAACGGTCATTGCA"]
    formats.write_reads(bank, str(tmp_path / "fa"))
    assert spark.read.text(str(tmp_path / "fa")).where("value like '>%'").count() == 3


def test_commands(spark, files):
    a, _, fof, tmp = files
    for name in ("link", "count"):
        cli.main([f"{name}-index", a, str(tmp / name), "-k", "7", "-a", "1", "-l"], spark)
    cli.main(["link", str(tmp / "link"), fof, str(tmp / "out"), "-l", "-t", "0"], spark)
    text = "".join(open(f).read() for f in sorted(glob.glob(str(tmp / "out/part-*"))))
    assert text.startswith("#query_read_id [") and text.count("#Query read set number") == 3 and text.count("0:0-20-100.000000 \n") == 3
    cli.main(["link", str(tmp / "link"), fof, str(tmp / "ids"), "-l", "-r"], spark)
    cli.main(["link", str(tmp / "link"), fof, str(tmp / "any"), "-l", "-s", "0"], spark)
    cli.main(["count", str(tmp / "count"), fof, str(tmp / "counts"), "-l"], spark)
    assert "0 100\n" in "".join(open(f).read() for f in glob.glob(str(tmp / "ids/part-*")))
    assert "0:0 \n" in "".join(open(f).read() for f in glob.glob(str(tmp / "any/part-*")))
    text = "".join(open(f).read() for f in sorted(glob.glob(str(tmp / "counts/part-*"))))
    assert "1 none\n" in text and " 100.000000\n" in text
    cli.main(["extract", str(tmp / "out"), a, str(tmp / "reads")], spark)
    assert ">r0 first read\n" in "".join(open(f).read() for f in glob.glob(str(tmp / "reads/part-*")))
    cli.main(["vector", str(tmp / "out"), "l", str(tmp / "v.bv"), "-s", "90"], spark)
    cli.main(["vector", str(tmp / "counts"), "c", str(tmp / "c.bv"), "-s", "90"], spark)
    assert open(tmp / "v.bv", "rb").read().endswith(b"#1\n\x01") and open(tmp / "c.bv", "rb").read().endswith(b"#2\n\x01")
    cli.main(["extract-vector", a, str(tmp / "v.bv"), str(tmp / "chosen")], spark)
    assert "".join(open(f).read() for f in glob.glob(str(tmp / "chosen/part-*"))) == ">r0 first read\nACGTTGCAACGGTCATTGCA\n"
    cli.main(["link", str(tmp / "link"), str(tmp / "self.txt"), str(tmp / "self"), "-l"], spark) if (tmp / "self.txt").write_text(a + "\n") else None
    for kind in cli.CONVERSIONS:
        cli.main(["convert", kind, str(tmp / ("counts" if kind in ("counted-reads", "covered-reads") else "self")), a, str(tmp / f"to-{kind}")], spark)
        text = "".join(open(f).read() for f in glob.glob(str(tmp / f"to-{kind}/**/part-*"), recursive=True))
        assert bool(text) == (kind not in ("pairs", "headers")), kind  # the file's one link is to itself
    with pytest.raises(index.NoSolidKmers):
        cli.main(["link-index", a, str(tmp / "none"), "-k", "7", "-a", "9"], spark)


def test_stream_of_queries(spark, tmp_path):
    bank = m.random_reads(3)
    made = index.linker_index(m.frame(spark, bank), 11, 1, True)
    schema = "read_set string, read_id long, header string, seq string, qual string"
    m.frame(spark, bank).write.parquet(str(tmp_path / "in"))
    query = stream_links(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), made, str(tmp_path / "out"), str(tmp_path / "cp"), 75, True, keep_low_complexity=True)
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("query_id", "target_id")
    want = linker.links(m.frame(spark, bank), made, 75, keep_low_complexity=True).select("query_id", "target_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_six_decimals_as_c_prints_them(spark):
    values = [0.0, 1 / 128, 3 / 128, 5 / 128, 12.5, 99.9999999, 100.0, 1 / 3, 0.01, 254.9921875]
    rows = spark.createDataFrame([(x,) for x in values], "mean float")
    got = rows.select("mean", formats.six(F.col("mean")).alias("line")).collect()
    assert [r["line"] for r in got] == [f"{r['mean']:.6f}" for r in got] and got[1]["line"] == "0.007812"


def test_bounds_of_means_are_in_single_precision(spark):
    rows = spark.createDataFrame([(0.01, 0.1), (0.02, 0.3)], "mean float, pct float")
    assert counter.mean_between(rows, 0.01, 0.01).count() == 1 and counter.pct_at_least(rows, 0.3).count() == 1
