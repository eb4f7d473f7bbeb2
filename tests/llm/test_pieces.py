import random

import numpy as np
import pytest

from trendloom.llm import suffix_pieces, token_counts
from trendloom.llm.pieces import MODEL, processor, vocabulary

HARD = ["a", "  a b ", "", "a\n\nb", "\t x", " ", "   ", "x" * 500, " <s> </s>", "é ﬁ ½ ①", "a\x00b", "日本語 テスト", "▁a ▁ b", "a▁b▁▁ c", "👍🏽 ok", "\n", "ab" * 300, "é " * 40]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    parts = ["a", "b", "e", "t", "h", " ", "▁", "\n", "é", "日", "1", "0", "①", ".", ",", "the", "ing", "  "]
    return HARD + ["".join(r.choice(parts) for _ in range(r.randint(1, 90))) for _ in range(400)]


def split(found):
    ids, counts = found
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_encoding_equals_the_library(texts):
    m, sp = suffix_pieces.Matcher(vocabulary(MODEL)), processor(MODEL)
    assert split(m.encode_texts(texts)) == [sp.encode(t) for t in texts]
    assert split(m.encode_texts(texts[::-1])) == [sp.encode(t) for t in texts[::-1]]  # from what it remembers


def test_forgetting_and_small_indexes_change_nothing(texts, monkeypatch):
    monkeypatch.setattr(suffix_pieces, "REMEMBERED", 50)
    monkeypatch.setattr(suffix_pieces, "INDEXED", 100)
    m, sp = suffix_pieces.Matcher(vocabulary(MODEL)), processor(MODEL)
    for k in range(0, 120, 20):
        assert split(m.encode_texts(texts[k : k + 20])) == [sp.encode(t) for t in texts[k : k + 20]]


def test_suffix_order_is_sorted():
    codes = np.array([3, 1, 2, 1, 2, 0, 3, 1])
    order = suffix_pieces.suffix_order(codes, 4).tolist()
    padded = codes.tolist() + [-1] * 4
    assert order == sorted(range(len(codes)), key=lambda i: padded[i : i + 4])


def test_decoding_gives_the_text_back(spark, docs, texts):
    df = docs(list(enumerate(texts)) + [(None, None), (3, "twice"), (3, "twice")])
    out = suffix_pieces.encode_checked(df)
    assert out.where("NOT same").count() == 0 and out.count() == len(texts) + 3
    back = {r.doc_id: r.text for r in suffix_pieces.decode(suffix_pieces.encode(docs(list(enumerate(texts))))).collect()}
    assert back == {k: t.replace("▁", " ") for k, t in enumerate(texts)}
    assert [r.text for r in suffix_pieces.decode(spark.createDataFrame([(1, None), (2, []), (3, [231])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()] == ["", "", "�"]
    assert suffix_pieces.encode(docs([])).count() == 0


def test_counts_equal_the_library(docs, texts):
    sp = processor(MODEL)
    rows = [*enumerate(texts), (9000, None), (9001, "word " * 5000)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(rows)).collect()}
    assert got == {i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in rows}
    assert got[9001][2] and got[9000] == (0, 0, False)
    assert token_counts.token_counts(docs([])).count() == 0


@pytest.mark.parametrize("signs", ["abcdefghij", "中文字符漢字测试", "äöüé日x\U0001f600b\u0301", "0123456789", "\n\t\0a▁", "ab "])
def test_long_stretches_are_cut_without_changing_counts(signs, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 64)
    sp, counter, r = processor(MODEL), token_counts.Counter(MODEL), random.Random(3)
    for n in (63, 64, 65, 66, 128, 129, 1000):
        text = "".join(r.choice(signs) for _ in range(n))
        for t in (text, " " + text, f"word {text} {text[:70]} end", text + " "):
            assert counter.count([t]) == [len(sp.encode(t))]
    parts = token_counts.stretches(" " + "漢字" * 300, counter.vocab.bigrams)
    assert len(parts) > 1 and parts[0] + "".join(p[1:] for p in parts[1:]) == " " + "漢字" * 300
    assert token_counts.stretches(" " + "a" * 300, counter.vocab.bigrams) == [" " + "a" * 300]  # any two neighbours are in some piece: nowhere to cut


def test_batches_are_balanced_by_bytes():
    assert list(token_counts.slices(np.array([5, 5, 20, 1, 1]), 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(token_counts.slices(np.array([], int), 10)) == []


def test_a_megabyte_of_text_and_repeated_rows(docs, prose):
    long = prose("en", 180_000)
    assert len(long) > 1_000_000
    sp = processor(MODEL)
    df = docs([(1, long), (1, long), (2, "é" * 40_000), (3, None)])
    out = suffix_pieces.encode_checked(df).collect()
    assert len(out) == 4 and all(r.same for r in out)
    assert [r.ids for r in out if r.doc_id == 1] == [sp.encode(long)] * 2
    counts = token_counts.token_counts(df).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in counts) == [(1, len(sp.encode(long)))] * 2 + [(2, len(sp.encode("é" * 40_000))), (3, 0)]
