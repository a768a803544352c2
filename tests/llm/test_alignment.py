from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from seqweave.llm import alignment
from seqweave.llm.queries import tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def paths():
    return tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bare(paths):
    """Encoders by the libraries alone: (id, bytes) of each token of a text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    one, two = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    one.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}

    def a(text):
        return [(k, bytes(byte[c] for c in one.id_to_token(k))) for k in one.encode(" " + text, add_special_tokens=False).ids]

    def b(text):
        return [(k, bytes([int(two.id_to_piece(k)[1:-1], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode()) for k in two.encode(text)]

    return a, b


def groups(a, b):
    """The groups by two pointers, a token at a time."""
    out, i, j, x, y, own = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            own[0].append(a[i][0])
            x += len(a[i][1])
            i += 1
        else:
            own[1].append(b[j][0])
            y += len(b[j][1])
            j += 1
        if x == y:
            out.append(own)
            own = ([], [])
    return out


def brute(docs, bare):
    found, counts = [], Counter()
    for doc_id, text in docs:
        a, b = (f(text) if text else [] for f in bare)
        whole = (" " + (text or "")).encode()
        own = groups(a, b) if text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else []
        found.append((doc_id, own))
        counts.update({(x, y) for g, h in own for x in g for y in h})
    most: dict = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for doc_id, own in found:
        every = [(x, y) for g, h in own for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in own)
        out.append((doc_id, sum(len(g) for g, _ in own), sum(len(h) for _, h in own), len(own), len(every), sum(counts[p] == most[p[0]] for p in every), sum(counts[p] for p in every), hashlib.sha256(text.encode()).hexdigest() if own else ""))
    return sorted(out, key=repr)


def some_docs(n=300):
    r = random.Random(5)
    odd = [None, "", " ", "  ", "a", "a ", "a  ", "   a", "\n", "\n\n a\t b", "it's 5 o'clock", "日本語 テキスト", "😀😀 ok 😀", "x ▁ y", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "ﬁ Å Å  　", "\x00 a\x00", "a" * 3000, "=" * 5000,
           "word " * 3000, "naïve café ÀÉß", "Ünïcödé " * 50, "\r\n \r\n", "🏳️‍🌈 é e\u0301", "q̈" * 200, "\U0001f600" * 400, "العربية हिन्दी ภาษาไทย"]
    made = ["".join(r.choice(["a", "b", "the ", " of", "\n", "é", "日", "😀", "  ", "1", "23", "'s", "Übung ", ". "]) for _ in range(r.randint(1, 60))) for _ in range(n)]
    return list(enumerate(odd + made)) + [(3, "a repeated row"), (3, "a repeated row"), (None, "a null id"), (None, "a null id")]


def frame(spark, docs):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, row long, pairs string")


def test_against_brute_force(spark, paths, bare):
    docs = some_docs()
    want = brute(docs, bare)
    got = alignment.aligned(frame(spark, docs).repartition(3), *paths)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(not n for _, n, *_ in want[5:]) and sum(n > 0 for _, n, *_ in want) > 200


def test_rare_pairs_are_joined_with_the_same_result(spark, paths, bare, monkeypatch):
    docs = some_docs(60)
    monkeypatch.setattr(alignment, "FREQUENT", 40)
    assert sorted(map(tuple, alignment.aligned(frame(spark, docs), *paths).collect()), key=repr) == brute(docs, bare)


def test_links_in_parts_and_of_large_groups(monkeypatch):
    """Groups of any size, links made a few at a time, and equal tokens counted first, give the same pairs."""
    r = np.random.default_rng(7)
    for limit, large in ((1 << 21, 1 << 12), (7, 1 << 12), (1 << 21, 2), (5, 3)):
        monkeypatch.setattr(alignment, "LINKS", limit)
        monkeypatch.setattr(alignment, "LARGE", large)
        for _ in range(20):
            n = int(r.integers(1, 9))
            sizes = r.integers(1, 7, (n, 2))
            a, b = r.integers(0, 4, sizes[:, 0].sum()), r.integers(0, 5, sizes[:, 1].sum())
            group_a, group_b = np.repeat(np.arange(n), sizes[:, 0]), np.repeat(np.arange(n), sizes[:, 1])
            doc = np.sort(r.integers(0, 3, n))
            want = Counter(int(doc[g]) * 30 + int(x) * 5 + int(y) for x, g in zip(a, group_a, strict=True) for y, h in zip(b, group_b, strict=True) if g == h)
            key, times = alignment._links(doc, a, group_a, b, group_b, n, 30, 5)
            assert dict(zip(key.tolist(), times.tolist(), strict=True)) == dict(want) and (np.diff(key) > 0).all()


def test_of_an_empty_table(spark, paths):
    assert alignment.aligned(frame(spark, []), *paths).count() == 0
    assert sorted(tuple(r) for r in alignment.aligned(frame(spark, [(1, None), (2, "")]), *paths).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pieces_by_stretches_equal_the_model(paths):
    """Stretches between blanks, remembered in tables that are soon full, give the model's ids of whole texts."""
    import pyarrow as pa
    from sentencepiece import SentencePieceProcessor

    from seqweave.arrow import raw

    model = SentencePieceProcessor(model_file=paths[1])
    texts = [t for _, t in some_docs(500) if t and "▁" not in t]
    enc = alignment.PieceEncoder(paths[1])
    assert enc.cut
    for slots, text, pool in ((64, 1 << 20, 1 << 20), (1 << 20, 300, 1 << 20), (1 << 20, 1 << 20, 200)):
        enc.SLOTS, enc.TEXT, enc.POOL = slots, text, pool
        enc.clear()
        for size in (len(texts), 7):
            got = []
            for k in range(0, len(texts), size):
                ids, at = enc.encode(*raw(pa.array([" " + t for t in texts[k : k + size]])))
                got += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)]
            assert got == model.encode(texts)
