from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from seqweave.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, row long, at long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values) -> str:
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) by the definition, one row at a time."""
    trees: dict = {}
    for doc_id, source, lang, n_chars, text in rows:
        trees.setdefault(lang, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, None if text is None else text.translate(LOWER))))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        own[name] = levels([x[1] for x in trees[name]])
    top = levels([own[name][-1][0] for name in names])
    out = []
    for at, name in enumerate(names):
        for k, (doc_id, was, low) in enumerate(trees[name]):
            folded = low if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else was
            proof = ""
            for nodes, place in ((own[name], k), (top, at)):
                for level in nodes[:-1]:
                    a = place // 8 * 8
                    left, right = level[a:place], level[place + 1 : a + 8]
                    proof += "".join(left + right)
                    folded = sha(*left, folded, *right)
                    place //= 8
            out.append((doc_id, was, own[name][-1][0], top[-1][0], sha(proof), folded))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


def proofs(docs, **options):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = manifest.leaf(*(low if c == "text" else F.col(c) for c in manifest.FIELDS))
    return manifest.build(docs, now=F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, found), **options).proofs()


def some_rows(n: int) -> list[tuple]:
    langs = ["en", "en", "en", "fr", None, "", "zz", "ä"]
    rows = [(k, f"s{k % 3}" if k % 5 else None, langs[k % 8] if k < n - 1 else "lone", k if k % 7 else None, f"Text {k} ü" if k % 11 else ("" if k % 2 else None)) for k in range(n)]
    return rows + rows[:9] + [(None, None, "en", None, None), (None, "a", "en", 1, "B" * 200_000), (None, "a", "en", 1, "B"), (-5, "a", "fr", 1, "Q")]


@pytest.mark.parametrize("height", [1, 2, 4])
def test_against_brute_force(spark, height):
    """Buckets of 8, 64 and 4,096 leaves; null fields, groups and ids, empty and long texts, repeated rows, extra columns of clashing names."""
    rows = some_rows(700)
    got = [tuple(r) for r in proofs(table(spark, rows), levels=height).collect()]
    want = brute(rows)
    assert sorted((r[:-1] for r in got), key=repr) == want
    assert all(verified == (folded == root) for *_, root, _, folded, verified in got)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_of_one_tree(spark, n):
    rows = [(k, "s", "en", 3, f"T{k}") for k in range(n)]
    assert sorted((tuple(r)[:-1] for r in proofs(table(spark, rows)).collect()), key=repr) == brute(rows)


def test_a_third_of_the_rows_repeats(spark):
    rows = [(7, "s", "en", 3, "Same")] * 300 + [(k, "s", "de", 3, f"T{k}") for k in range(500)]
    assert sorted((tuple(r)[:-1] for r in proofs(table(spark, rows)).collect()), key=repr) == brute(rows)


def test_of_an_empty_table(spark):
    built = manifest.build(table(spark, []))
    assert built.root is None and built.proofs().count() == 0 and built.subroots.count() == 0


def test_an_unchanged_table_verifies_and_has_one_root(spark):
    docs = table(spark, [(k, None, None, None, "a") for k in range(20)])
    built = manifest.build(docs)
    assert built.proofs().where("not verified").count() == 0
    assert manifest.build(docs.repartition(7)).root == built.root
    assert manifest.build(docs.limit(19)).root != built.root
