from __future__ import annotations

import hashlib
import math
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard as zstd

from seqweave.llm import _common, sharding, token_output, warc
from seqweave.llm._common import raw, shared_dir
from seqweave.llm.queries import tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")


# --- tokens ---------------------------------------------------------------------------------------------------------------


def some_texts(n=800):
    r = random.Random(1)
    out = ["", "a", " ", "  ", "\n", " \n a", "it's 5", "'s", "x  y", "x \n\n y", "日本 语", "ab×cd", "12ab!!  \t!", "\x00\x1c a", "a b", "ÀÉ ß", "<|endoftext|>", "!", "😀" * 50]
    return out + ["".join(r.choice("ab1 !\n\té'") for _ in range(r.randint(0, 30))) for _ in range(n)] + ["word " * 5000]


def bare():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_the_tokenizer():
    texts = some_texts()
    want = [e.ids for e in bare().encode_batch(texts, add_special_tokens=False)]
    enc = token_output.WordEncoder(tokenizer_path())
    for slots, text, pool in ((64, 1 << 20, 1 << 20), (1 << 20, 300, 1 << 20), (1 << 20, 1 << 20, 200)):  # pieces fight for slots; tables that are soon full
        enc.SLOTS, enc.TEXT, enc.POOL = slots, text, pool
        enc.clear()
        for size in (len(texts), 7, len(texts)):
            got = []
            for k in range(0, len(texts), size):
                ids, at = enc.encode(*raw(pa.array(texts[k : k + size])))
                got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
            assert got == want


@pytest.mark.parametrize("n", [1024, 2048])
def test_pieces_of_equal_hashes_are_told_apart(n):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    data, cuts = np.frombuffer((word + other).encode(), np.uint8), np.array([0, n, 2 * n])
    hashes = token_output.Hashes(data).of(cuts[:-1], cuts[1:])
    texts = [word, other, word[:200], other[:200], other, word]
    enc, want = token_output.WordEncoder(tokenizer_path()), [e.ids for e in bare().encode_batch([word, other, word[:200], other[:200], other, word], add_special_tokens=False)]
    for one in (texts[:1], texts[1:2], texts):
        ids, at = enc.encode(*raw(pa.array(one)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [want[texts.index(x)] for x in one]
    assert hashes[0] == hashes[1]  # the polynomial alone doesn't tell them apart


def test_words_of_equal_polynomials_are_told_apart():
    from seqweave.llm._words import Words

    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    data = np.frombuffer((word + " " + word.translate(str.maketrans("ab", "ba")) + " " + word).encode(), np.uint8)
    h = Words(data, np.array([0, len(data)])).hashes
    assert h[0] != h[1] and h[0] == h[2]


def test_special_tokens_are_read_as_the_bare_library_reads_them(spark):
    from tokenizers import Tokenizer

    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "no <|endoftext| here", "<|endof", "text|>", "it's <|endoftext|>", "plain words"] + some_texts()
    library = Tokenizer.from_file(tokenizer_path())
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [87, 220, 50256, 331]
    ids, at = token_output.WordEncoder(tokenizer_path()).encode(*raw(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_output.token_round_trip(spark, frame, tokenizer_path()).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == [(k, len(w) + 1, zlib.crc32(np.array([*w, 0], "<u4").tobytes())) for k, w in enumerate(want)]


def pairs_left(symbols, docs, least):
    """Pairs inside documents that still occur so often, of a run of one symbol every second place."""
    count: dict[tuple, int] = {}
    for a, b in zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True):
        x, taken = symbols[a:b].tolist(), -1
        for i in range(len(x) - 1):
            if x[i] == x[i + 1]:
                if taken == i - 1 and i and x[i - 1] == x[i]:
                    continue
                taken = i
            count[x[i], x[i + 1]] = count.get((x[i], x[i + 1]), 0) + 1
    return [p for p, n in count.items() if n >= least]


@pytest.mark.parametrize(("vocab", "least", "step"), [(50_257, 2, 16), (70_000, 3, 1), (4, 2, 4), (50_257, 5, 1 << 30)])
def test_grammar_round_trip(vocab, least, step):
    r = np.random.default_rng(2)
    sizes = np.concatenate([r.integers(0, 60, 300), [0, 0, 5000]])
    ids = r.integers(0, min(vocab, 12), sizes.sum()).astype(np.uint32)
    ids[-5000:] = np.tile(ids[:50], 100)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    symbols, docs, rules, lengths = token_output.compress(ids, offsets, vocab, least, step)
    assert len(rules) and len(symbols) < len(ids) and not pairs_left(symbols, docs, least)
    grammar = token_output.Grammar(vocab, rules, lengths)
    assert (grammar.expand(symbols) == ids).all() and (grammar.expand_many(symbols) == ids).all()
    assert lengths.tolist() == [len(grammar.expand(np.array([vocab + k], np.uint32))) for k in range(len(rules))]
    for k in range(len(sizes)):
        own, want = symbols[docs[k] : docs[k + 1]], ids[offsets[k] : offsets[k + 1]]
        assert (grammar.expand(own) == want).all()
        for a, b in ((0, 0), (0, len(want)), (len(want) // 3, len(want) // 2), (len(want) - 1, len(want))):
            if 0 <= a <= b:
                assert (grammar.part(own, a, b) == want[a:b]).all()
    for ids in (np.zeros(0, np.uint32), np.zeros(1, np.uint32), np.full(1000, 3, np.uint32)):
        symbols, docs, rules, lengths = token_output.compress(ids, np.array([0, len(ids)]), vocab, least, step)
        assert (token_output.Grammar(vocab, rules, lengths).expand(symbols) == ids).all() and not pairs_left(symbols, docs, least)


def test_bits_come_back():
    r = np.random.default_rng(4)
    for bits, n in ((1, 9), (7, 0), (16, 70_000), (17, 140_001), (32, 11)):
        x = r.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = token_output.pack_bits(x, bits)
        assert len(data) == (n * bits + 7) // 8
        for a in (0, 3, n // 2):
            if a <= n:
                assert (token_output.unpack_bits(data, bits, a, n - a) == x[a:]).all()


def brute_tokens(rows):
    t = bare()
    coded = [(k, t.encode(x or "", add_special_tokens=False).ids + [0]) for k, x in rows]
    return sorted(((k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in coded), key=repr)


def test_token_files_come_back(spark, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_TOKENS", 3000)
    rows = [(i * 7 % 1000 - 300, t) for i, t in enumerate(some_texts())] + [(5, None), (None, "no id"), (5, "again"), (5, "again")] + [(77, f"hot {i}") for i in range(700)]
    frame = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, shard int")
    manifest = token_output.write_tokens(frame, shared_dir(spark, "t"), tokenizer_path(), shards=6, least=2)
    got = token_output.read_tokens(manifest).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == brute_tokens(rows)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order]).tolist()[:-1]]
    ids = [r["doc_id"] if r["doc_id"] is not None else -(1 << 62) for r in order]
    assert ids == sorted(ids)
    files = manifest.collect()
    assert max(f["n_docs"] for f in files) < 0.5 * len(rows)  # the id with a third of the rows is spread
    assert token_output.read_tokens(token_output.write_tokens(frame.where("false"), shared_dir(spark, "t"), tokenizer_path())).count() == 0


def test_random_access(spark, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_TOKENS", 700)
    rows = [(i * 3, f"text number {i} with some more words and {i % 7} again " * (1 + i % 5)) for i in range(150)] + [(None, "no id"), (3000, None), (3001, ""), (3002, "end")]
    manifest = token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), shared_dir(spark, "t"), tokenizer_path(), shards=1, least=2).collect()
    shard, t = token_output.ShardFile(manifest[0]["path"]), bare()
    assert len(shard.low) > 5
    for k, x in rows:
        want = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert shard.document(k).tolist() == want
        assert shard.document(k, 1, len(want) - 1).tolist() == want[1:-1] and shard.document(k, len(want) // 2).tolist() == want[len(want) // 2 :]
    assert shard.document(1) is None and shard.document(99_999) is None and shard.document(-5) is None
    read = []
    one = token_output.Block(lambda place, size, get=shard.block(1)._read: read.append(size) or get(place, size))
    assert one.document(0).tolist() == shard.block(1).document(0).tolist() and sum(read) < 0.8 * (shard.places[2] - shard.places[1])
    shard.close()


# --- WARC -----------------------------------------------------------------------------------------------------------------


def test_archives_come_back(spark, monkeypatch):
    r = random.Random(3)
    html = ["<html>" + "".join(r.choice("abc é\r\n") for _ in range(r.randint(0, 400))) for _ in range(40)]
    rows = [(i, f"http://x/{i}?a b\r\n", html[i % 40]) for i in range(120)] + [(200, None, None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (204, "u", "x" * 300_000), (205, "u", "x" * 300_000), (0, "again", html[0]), (None, "no id", "y" * 150), (None, "no id", "y" * 150), (300, "u", "y" * 150), (None, None, "short"), (None, "all without", "z" * 150)]
    frame = spark.createDataFrame([(*x, "s") for x in rows], "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, warc.archive_round_trip(spark, frame).collect()), key=repr)
    first: dict[str, int] = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and i is not None and first[h or ""] != i  # a row without an id can be no revisit
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    monkeypatch.setattr(_common, "BROADCAST", 0)
    monkeypatch.setattr(_common, "LARGE_GROUP", 2)
    assert sorted(map(tuple, warc.archive_round_trip(spark, frame).collect()), key=repr) == got
    assert warc.archive_round_trip(spark, frame.where("false")).count() == 0


def test_records_are_frames_of_their_own_behind_the_dictionary(spark):
    rows = [(i, "u", f"<html><body>page {i} of many with the same words in it {'lorem ' * (i % 7)}</body></html>") for i in range(300)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), shared_dir(spark, "w"))
    total = 0
    for f in manifest.collect():
        data = open(f["path"].removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.DICTIONARY_FRAME
        own = zstd.ZstdCompressionDict(data[8 : 8 + size], dict_type=zstd.DICT_TYPE_AUTO if data[8:12] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT)
        rest = data[8 + size :]
        while rest:
            one = zstd.ZstdDecompressor(dict_data=own).decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, total = one.unused_data, total + 1
    assert total == 300


# --- sharding -------------------------------------------------------------------------------------------------------------


def test_shards(spark):
    tree = sharding.Tree.even(2, 3, 4)
    rows = [(i, None if i % 50 == 0 else "é" * (i % 9)) for i in range(6000)] + [(5, "é" * 5), (None, "x"), (7000, "y" * 300_000)]
    frame = spark.createDataFrame([(*x, 3) for x in rows], "doc_id long, text string, shard int")
    got = sharding.sharded(frame, tree, tree.grown(1, 2)).collect()
    assert len(got) == len(rows)
    slots: dict[int, list] = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(180 < len(s) < 320 for s in slots.values()) and 160 < sum(r["grown_shard"] == 24 for r in got) < 320
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sharding.sharded(frame.where("false"), tree).count() == 0


def xx64(*parts):
    """Spark's xxhash64: each value hashed with the last hash as its seed."""
    import xxhash

    h = 42
    for x in parts:
        h = xxhash.xxh64(x.encode() if isinstance(x, str) else struct.pack("<I", x & 0xFFFFFFFF) if isinstance(x, int) else x, seed=h).intdigest()
    return h


def brute_shard(key, tree, seed=0):
    """The shard by hand: the earliest exponential time wins at each level."""

    def time(node, weight):
        # an int is hashed as four bytes in Spark
        u = ((xx64(key, node, seed) >> 11) + 0.5) / (1 << 53)
        return -math.log(u) / weight

    leaves = tree.leaves()
    live = lambda rack: any(w > 0 for _, w in rack)
    top = [(time(str(i), sum(map(sum, region))), i, None) for i, region in enumerate(tree.regions) if any(map(live, leaves[i]))]
    top += [(time(f"+{k}/{i}/{j}/{shard}", w), -1, shard) for k, (i, j, shard, w) in enumerate(tree.added) if shard not in tree.drained]
    _, region, late = min(top)
    if late is not None:
        return late
    _, rack = min((time(f"{region}/{j}", sum(w)), j) for j, w in enumerate(tree.regions[region]) if live(leaves[region][j]))
    return min((time(f"{region}/{rack}/{n}", w), n) for n, w in leaves[region][rack] if w > 0)[1]


def test_shards_equal_a_computation_by_hand(spark):
    pytest.importorskip("xxhash")
    from pyspark.sql import functions as F

    tree = sharding.Tree((((1.0, 3.0), (2.0,)), ((4.0, 0.0, 1.5),), ((0.5,), (0.5, 0.5), (2.0,))))
    for t in (tree, tree.grown(0, 0, 5.0, shard=0).grown(1, 0, 2.0), tree.grown(2, 1).without(2).without(5), sharding.Tree.even(2, 3, 4)):
        got = sharding.with_shard(spark.range(700).select(F.col("id").cast("string").alias("k")), F.col("k"), t, 3).collect()
        assert [(r["k"], r["shard"]) for r in got] == [(r["k"], brute_shard(r["k"], t, 3)) for r in got]


def test_weights_and_confined_movement(spark):
    from pyspark.sql import functions as F

    tree = sharding.Tree((((1.0, 3.0), (2.0,)), ((4.0, 0.0),)))
    more, less, none = tree.grown(0, 0, 5.0, shard=0), tree.without(1), tree.without(0).without(1)
    ids = spark.range(30_000)
    for column, t in (("a", tree), ("b", more), ("c", less), ("d", none)):
        ids = sharding.with_shard(ids, F.col("id"), t, column=column)
    rows = ids.collect()
    share = [sum(r["a"] == k for r in rows) / 30_000 for k in range(5)]
    assert share == pytest.approx([0.1, 0.3, 0.2, 0.4, 0], abs=0.012) and share[4] == 0
    assert all(r["b"] in (r["a"], 0) for r in rows) and sum(r["b"] == 0 for r in rows) / 30_000 == pytest.approx(6 / 15, abs=0.012)
    assert all(r["c"] == (0 if r["a"] == 1 else r["a"]) for r in rows)  # a drained shard's rows stay in its rack
    assert all(r["d"] == (2 if r["a"] < 2 else r["a"]) for r in rows)  # those of an empty rack in its region


def test_rows_that_repeat_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    tree = sharding.Tree.even(1, 2, 2)
    got = sharding.sharded(spark.createDataFrame([(1, "same")] * 100 + [(None, None)] * 50 + [(2, "x"), (1, "other")], "doc_id long, text string"), tree).collect()
    slots: dict[int, list] = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 152 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1


def test_shards_are_written(spark, tmp_path):
    tree = sharding.Tree.even(1, 2, 2)
    sharding.write_shards(spark.createDataFrame([(i, "t") for i in range(100)], "doc_id long, text string"), str(tmp_path / "s"), tree)
    assert len([x for x in os.listdir(tmp_path / "s") if x.startswith("shard=")]) == 4
