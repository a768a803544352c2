"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts, each document scanned once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.dataset as pds
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, held, raw, shared_dir, small_batches, tidy, without, written
from ._words import WORD_TABLE

#: Words of a window; windows of an automaton at most, about. A larger benchmark takes several automata, which take turns over so many bytes of text.
WINDOW, WINDOWS, HELD = 10, 20_000, 32 << 20
#: Words are runs of word bytes, one blank between them.
_TO_WORDS = bytes(int(b) if b else 0x20 for b in WORD_TABLE)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(_TO_WORDS).split()


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(pattern, items): the distinct windows of items, the words separated by blanks, and the sorted items that have each."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = words_of(text)
                out += [(b" " + b" ".join(own[i : i + window]) + b" ", k) for i in range(max(1, len(own) - window + 1)) if own]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([k for _, k in out], pa.int64())], ["pattern", "item"])

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).mapInArrow(kernel, "pattern binary, item long")
    return rows.groupBy("pattern").agg(F.array_sort(F.collect_set("item")).alias("items"))


def automaton(name: str, patterns: Callable[[], list]) -> ahocorasick.Automaton:
    """This worker's automaton, one at a time; patterns are searched as Latin-1 so that places are bytes."""
    own = held("automaton")
    if name not in own:
        own.clear()
        made = ahocorasick.Automaton()
        for pattern, items in patterns():
            made.add_word(pattern.decode("latin-1"), (len(pattern), pattern.count(b" ") - 1, items))
        made.make_automaton()
        own[name] = made
    return own[name]


def _spans(batch: pa.RecordBatch, find: ahocorasick.Automaton) -> Iterator[tuple]:
    """(row, words, hit word ranges, items) of each text."""
    data, offsets = raw(batch.column("text"))
    joined = data.tobytes()
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own = joined[a:b].translate(_TO_WORDS).split()
        line = b" " + b" ".join(own) + b" "
        hits = [(end, *what) for end, what in find.iter(line.decode("latin-1"))] if own and len(find) else []
        if hits:
            before = np.cumsum(np.frombuffer(line, np.uint8) == 0x20)
            yield k, len(own), [(int(before[end]) - 1 - n, int(before[end]) - 1) for end, _, n, _ in hits], {i for *_, items in hits for i in items}
        else:
            yield k, len(own), [], set()


def _merged(spans: list) -> list[list[int]]:
    """Ranges that touch or overlap as one, in order."""
    merged: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return merged


def _result(block: pa.RecordBatch, found: list[tuple], places: bool) -> pa.RecordBatch:
    """The output rows of a block from (words, merged ranges, items) of each."""
    nested = pa.list_(pa.list_(pa.int64()))
    chars = [_original(block.column("text")[k].as_py(), spans) if places and spans else [] for k, (_, spans, _) in enumerate(found)]
    columns = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([spans for _, spans, _ in found], nested), pa.array([sorted(items) for *_, items in found], pa.list_(pa.int64())), pa.array(chars, nested)]
    return pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], ["doc_id", "n_words", "spans", "items", "chars"])


def _scan(parts: list, places: bool):
    """parts: for each automaton its name and what gives its patterns. Several take turns over about HELD bytes of text, so that each is seldom made anew."""

    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped((b for batch in batches for b in blocks(batch, "text")), HELD if len(parts) > 1 else 0):
            found: list[list[tuple]] = [[] for _ in group]
            for name, patterns in parts:
                find = automaton(name, patterns)
                for k, block in enumerate(group):
                    own = [(n, _merged(hit), items) for _, n, hit, items in _spans(block, find)]
                    found[k] = [(n, _merged([*was, *hit]), known | items) for (_, was, known), (n, hit, items) in zip(found[k], own, strict=True)] if found[k] else own
            for block, own in zip(group, found, strict=True):
                yield _result(block, own, places)

    return kernel


def grouped(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of blocks with at least so many bytes of text."""
    group, have = [], 0
    for block in parts:
        group.append(block)
        have += block.column("text").nbytes
        if have >= size:
            yield group
            group, have = [], 0
    if group:
        yield group


def _stored(folder: str):
    """What reads the patterns of a part in the shared folder."""

    def patterns() -> list[tuple]:
        system, name = pafs.FileSystem.from_uri(folder)
        if system.get_file_info(name).type == pafs.FileType.NotFound:
            return []
        table = pds.dataset(name, filesystem=system, format="parquet").to_table(columns=["pattern", "items"])
        return list(zip(table.column("pattern").to_pylist(), table.column("items").to_pylist(), strict=True))

    return patterns


def _original(text: str, spans: list[list[int]]) -> list[list[int]]:
    """The character ranges in the text itself of ranges of words."""
    data = np.frombuffer(text.encode(), np.uint8)
    inside = WORD_TABLE[data] != 0
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [[int(char[start[a]]), int(char[end[b - 1]])] for a, b in spans]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most: int = WINDOWS, places: bool = True) -> DataFrame:
    """(doc_id, n_words, spans, items, chars), one row for each row of docs: word ranges hit, items found, and with places the same ranges in characters of the text.

    Null and empty texts have no words and no hits; an item without words has no window, and an item of fewer words than
    window is one window. Equal windows of several items count for each. The windows are files of about `most` in the
    shared folder, which workers read; one automaton holds a file's, and where there are several, a task scans its rows
    with each in turn. An empty benchmark hits nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = written(windows(items, item_col, item_text_col, window), "windows")
    passes = max(1, -(-found.count() // most))
    folder = shared_dir(spark, "automata")
    found.withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(passes))).repartition("part").write.partitionBy("part").parquet(folder)
    scan = _scan([(f"{folder}/{k}", _stored(f"{folder}/part={k}")) for k in range(passes)], places)
    return base.mapInArrow(scan, f"doc_id {dict(base.dtypes)['doc_id']}, n_words long, spans array<array<long>>, items array<long>, chars array<array<long>>")


def contamination_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_chars) of contamination(); hit_chars: the places, from-to, in characters of the text."""
    ranges = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s[1] - F.greatest(s[0], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s[1]).alias("upto")),
    )
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    places = F.array_join(F.transform("chars", lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string"))), ",")
    return found.select("doc_id", "n_words", ranges["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"), places.alias("hit_chars"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without any window of the benchmark, with all their columns, each judged by its own text."""

    def hit(keyed: DataFrame, key: str) -> DataFrame:
        return contamination(keyed, items, key, text_col, places=False, **options).where(F.size("items") > 0).select(F.col("doc_id").alias(key))

    return without(docs, id_col, text_col, hit)
