"""Alignment of tokenizers against brute force with the tokenizers on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from statuteflow.llm import token_alignment as T

PIECES = [
    "the ", "The", " word", "words ", "  ", "   ", "\n", " \n ", "\t", "\r\n", "12345", " 3.5", "don't", "'s ", "é", "ç ", "ß", "日本語", "日本 語", "🙂", "🙂 ", " ", "  x", "  y", "　", "▁", "▁ ", " ▁",
    "<|endoftext|>", "<s>", "</s> ", "<unk>", "<0x41>", "!!", "...", "http://a.b/c?d=e", "\x00", "\x7f ", "\x1c ", "\x85 ", "ﬁ", "x" * 30, "ạ̈", "​ ", "﻿", "İ", "ſ",
]

BYTE_LEVEL = Tokenizer.from_file(T.BYTE_BPE)
BYTE_LEVEL.encode_special_tokens = True


@pytest.fixture(scope="module")
def encoders():
    return T.Encoders(T.BYTE_BPE, T.PIECE_BPE)


def whole(encoders, text):
    """Tokens of the tokenizers on the whole text, or none."""
    if not text:
        return [], []
    a = BYTE_LEVEL.encode(" " + text, add_special_tokens=False).ids
    b = encoders.b.encode(text)
    raw = (" " + text).encode()
    join = lambda ids, table: b"".join(table[i] for i in ids)
    return (a, b) if join(a, encoders.bytes_a) == raw == join(b, encoders.bytes_b) else ([], [])


def brute(encoders, docs):
    linked, out = [], []
    for _, text in docs:
        a, b = whole(encoders, text)
        spans = []
        for ids, table in ((a, encoders.bytes_a), (b, encoders.bytes_b)):
            ends = np.cumsum([0] + [len(table[i]) for i in ids])
            spans.append(list(zip(ends[:-1].tolist(), ends[1:].tolist())))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, own) if low <= s and e <= cut) for ids, own in zip((a, b), spans)))
            low = cut
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, u) in enumerate(spans[1]) if s < u and t < e]
        linked.append(links)
        out.append((a, b, groups))
    count = Counter(pair for links in linked for pair in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return sorted([
        (i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for (i, _), (a, b, groups), links in zip(docs, out, linked)
    ], key=repr)


def answer(spark, docs):
    table = spark.createDataFrame([(i, t, 5, "c") for i, t in docs], "doc_id long, text string, chunk int, pairs string").repartition(3)
    return sorted([tuple(r) for r in T.align_tokens(table).collect()], key=repr)


def made():
    rng = random.Random(13)
    docs = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " "), (203, "a"), (204, docs[3][1]), (3, docs[3][1]), (None, docs[4][1]), (205, "word " * 400), (206, "日本語" * 300), (207, "x" * 2_000), (208, " " * 700)]
    return docs


def test_rows_are_those_of_brute_force(spark, encoders):
    assert answer(spark, made()) == brute(encoders, made())


def test_small_windows_and_lanes_change_nothing(encoders, monkeypatch):
    texts = [(t or "").encode() for _, t in made()]
    want = T.Aligned(encoders, texts)
    monkeypatch.setattr(T, "WINDOW_BYTES", 40)
    monkeypatch.setattr(T, "LANE", 3)
    got = T.Aligned(encoders, texts)
    assert (got.counts == want.counts).all() and got.hashes == want.hashes
    summed = lambda x: Counter({(r, p): 0 for r, p in zip(x.row.tolist(), x.pairs[x.code].tolist())}) + Counter(
        k for r, p, n in zip(x.row.tolist(), x.pairs[x.code].tolist(), x.times.tolist()) for k in [(r, p)] * n
    )
    assert summed(got) == summed(want)
    assert dict(zip(got.pairs.tolist(), got.pair_times.tolist())) == dict(zip(want.pairs.tolist(), want.pair_times.tolist()))


def test_tokens_are_those_of_the_file(encoders):
    """The merges run as the file's own library runs them: every token of the vocabulary, every character, beside others."""
    own = [t for t in (b.decode("utf-8", "ignore") for b in encoders.bytes_a) if t]
    rng = random.Random(1)
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [chr(c) for c in rng.sample(range(0xE000, 0x20000), 3_000)]
    mixed = [f"{c} {c}a {rng.choice(chars)}{c}  {c}1 {c}'s" for c in chars]
    for texts in (own, mixed):
        assert [x.ids for x in BYTE_LEVEL.encode_batch_fast(texts, add_special_tokens=False)] == [encoders.a.encode_ordinary(t) for t in texts]


def test_parts_of_long_texts_hold_whole_tokens(encoders, monkeypatch):
    monkeypatch.setattr(T, "WINDOW_BYTES", 5)
    for _, text in made():
        if text:
            parts = [t.decode() for _, t in T.pieces(0, text.encode())]
            assert " ".join(parts) == text
            assert sum([BYTE_LEVEL.encode(" " + t, add_special_tokens=False).ids for t in parts], []) == BYTE_LEVEL.encode(" " + text, add_special_tokens=False).ids
            assert sum(encoders.b.encode(parts), []) == encoders.b.encode(text)


def test_packed_numbers_come_back():
    values = np.array([0, 5, 3, 4_000_000_000, 7], dtype="<u4")
    assert T.unpacked(T.packed(values)).tolist() == values.tolist() and len(T.unpacked(b"")) == 0


def test_empty_table(spark):
    assert answer(spark, []) == []
