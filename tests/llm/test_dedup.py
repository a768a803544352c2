from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from seqweave.llm import _common, exact_dedup, near_dedup
from seqweave.llm._words import Words, shingles

SCHEMA = "doc_id long, text string, kept string, bands int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], SCHEMA)


def sets_of(texts, size=5):
    data = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    return shingles(Words(np.concatenate(data) if data else np.zeros(0, np.uint8), off), size)


def brute_words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "").split()


def brute_sets(text, size=5):
    w = brute_words(text)
    out: dict[tuple, int] = {}
    for k in range(max(1, len(w) - size + 1) if w else 0):
        out[tuple(w[k : k + size])] = out.get(tuple(w[k : k + size]), 0) + 1
    return out


def brute_jp(a, b):
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in a if d in b)


def corpus(seed, n=60, words=60):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    base = [[r.choice(vocab) for _ in range(words)] for _ in range(8)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6, 12])):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append((" " if r.random() < 0.5 else ", ").join(w) + (" " + " ".join(w[:20]) if r.random() < 0.2 else ""))
    return out


def test_probability_jaccard_and_signatures():
    texts = corpus(1, 30)
    sets, brute = sets_of(texts), [brute_sets(t) for t in texts]
    assert [len(h) for h, _ in sets] == [len(b) for b in brute]
    sig = near_dedup.signatures(sets, 1024)
    for i in range(30):
        for j in range(i):
            exact = near_dedup.probability_jaccard(sets[i], sets[j])
            assert exact == pytest.approx(brute_jp(brute[i], brute[j]))
            assert abs((sig[i] == sig[j]).mean() - exact) < 0.09  # 5.5 standard deviations at most
    for n in (1, 2, 3):  # few elements, and the same signature whatever the block
        assert (near_dedup.signatures([(np.arange(1, n + 1, dtype=np.uint64), np.ones(n))])[0] != 0).all()
    assert (near_dedup.signatures([sets[4]]) == near_dedup.signatures(sets)[4]).all()


def classes(texts):
    sets = [brute_sets(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (k, t) in enumerate(texts):
        for j in range(i):
            same = (brute_jp(sets[i], sets[j]) >= 0.8 - 1e-9 if sets[i] and sets[j] else not sets[i] and not sets[j] and (t or "") == (texts[j][1] or ""))
            if same:
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (k, _) in enumerate(texts):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, least.get(root(i)), root(i)) for i, (k, _) in enumerate(texts)), key=repr)


@pytest.mark.parametrize("large", [64, 2])
def test_near_duplicates_match_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "STAR", 3)
    texts = list(enumerate(corpus(2, 110))) + [(200, ""), (201, None), (202, "!!!"), (203, "???"), (204, "!!!"), (205, "one two"), (206, "One,  two"), (207, "one two three"), (0, corpus(2, 1)[0]), (0, corpus(2, 1)[0]), (5, "a text of its own that shares an id"), (300, "long " * 30_000), (301, "Long " * 30_000)]
    texts += [(None, corpus(2, 3)[2]), (None, corpus(2, 3)[2]), (None, corpus(2, 3)[1] + " more"), (None, "nobody has this text at all"), (None, "nobody has this text at all"), (None, None)]
    got = near_dedup.near_duplicates(frame(spark, texts))
    assert got.columns == ["doc_id", "class_id", "kept"]
    rows, want = got.collect(), classes(texts)
    assert sorted(((r["doc_id"], r["class_id"]) for r in rows), key=repr) == sorted(((k, c) for k, c, _ in want), key=repr)
    assert all(r["doc_id"] == r["class_id"] for r in rows if r["kept"])
    assert sorted((r["class_id"] for r in rows if r["kept"]), key=repr) == sorted((c for c, _ in {(c, root) for _, c, root in want}), key=repr)


def template_texts():
    """Texts that share a long passage but aren't alike, and near copies among them."""
    r = random.Random(9)
    shared = " ".join("p%d" % i for i in range(60))
    own = [" ".join(r.choice("abcdefgh") + str(r.randrange(500)) for _ in range(45)) for _ in range(40)]
    return [(i, f"{shared} {x}") for i, x in enumerate(own)] + [(100 + i, f"{shared} {x} end") for i, x in enumerate(own[:15])]


def test_texts_that_share_a_passage_are_not_all_compared(spark, monkeypatch):
    texts = template_texts()
    compared = []
    plain = near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    got = near_dedup.near_duplicates(frame(spark, texts), band=2, slots=128).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted((k, c) for k, c, _ in classes(texts))
    assert len(compared) == 2 and compared[1] < 60  # of 1,485 pairs


def test_prefixes_of_alike_sets_meet():
    texts = corpus(6, 40)
    sets = sets_of(texts)
    count = np.zeros(1 << near_dedup.CELL_BITS, np.int32)
    for h, _ in sets:
        count[(h >> np.uint64(64 - near_dedup.CELL_BITS)).astype(np.int64)] += 1
    first = [set(near_dedup.prefix(h, w, count, 0.8).tolist()) for h, w in sets]
    for p, (h, w) in zip(first, sets, strict=True):
        inside = np.isin(h, np.array(sorted(p), np.uint64))
        assert w[~inside].sum() < 0.8 * w.sum() <= w[~inside].sum() + w.max()  # no longer than need be
    alike = [(i, j) for i in range(40) for j in range(i) if near_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8]
    assert len(alike) > 20 and all(first[i] & first[j] for i, j in alike)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.deduplicated(frame(spark, [])).columns == ["doc_id", "text", "kept", "bands"]


def test_one_document_of_a_class_stays(spark):
    texts = list(enumerate(corpus(3, 40)))
    texts += [(0, texts[0][1]), (0, "another text with the same id as the first"), (39, texts[38][1]), (39, "unrelated words of a row whose id is in another class"), *[(None, "fine words")] * 3, (None, None), (None, "")]
    got = near_dedup.deduplicated(frame(spark, texts))
    kept = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=repr)
    assert got.columns == ["doc_id", "text", "kept", "bands"] and len(kept) == len({root for *_, root in classes(texts)})
    groups: dict = {}
    for (k, t), (_, c, root) in zip(sorted(texts, key=repr), sorted_by_text(texts), strict=True):
        groups.setdefault(root, []).append((k, t or ""))
    assert all(sum(x in g for x in kept) == 1 for g in groups.values())


def sorted_by_text(texts):
    """classes() of each of the texts, in the order of sorted(texts, key=repr)."""
    ordered = sorted(texts, key=repr)
    numbered = classes([(i, t) for i, (_, t) in enumerate(ordered)])
    return sorted(numbered)


def test_components_of_a_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    assert {tuple(r) for r in near_dedup.components(links).collect()} == {(i, 0) for i in range(n + 1)} | {(1000, 1000), (1001, 1000)}


def exact_brute(texts):
    groups: dict[str, list] = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    key = lambda g: max((x for x in g if x is not None), default=None)
    return sorted(((i, key(groups[t or ""]), len(groups[t or ""]), i == key(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts), key=repr)


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_exact_duplicates_match_brute_force(spark, monkeypatch, bits):
    r = random.Random(4)
    longer = ["".join(r.choice("abcd ef\n") for _ in range(r.randint(0, 3000))) for _ in range(15)]
    texts = [(i, r.choice(longer)) for i in range(40)] + [(50, ""), (51, None), (52, "a"), (53, "a "), (53, "a "), (None, "a"), (54, longer[0] + "x"), (55, "x" + longer[0]), (56, "é" * 9000), (57, "é" * 9000), (None, "only")]
    for broadcast in (200_000, 0):
        monkeypatch.setattr(_common, "BROADCAST", broadcast)
        monkeypatch.setattr(_common, "LARGE_GROUP", 3)
        got = exact_dedup.exact_duplicates(frame(spark, texts), hash_bits=bits, least=16, most=64)
        assert sorted(map(tuple, got.collect()), key=repr) == exact_brute(texts)


def test_chunks_join_to_the_text_and_edits_stay_local(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdefghijklmnop qrstu\n") for _ in range(20_000))
    rows = spark.createDataFrame([(text,), (text[:9000] + "XX" + text[9000:],)], "t string").select(exact_dedup.chunks(__import__("pyspark").sql.functions.col("t")).alias("c")).collect()
    a, b = rows[0]["c"], rows[1]["c"]
    assert "".join(a) == text and len(set(a) - set(b)) <= 3 and max(map(len, a)) <= exact_dedup.MOST


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
