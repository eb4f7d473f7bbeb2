import random
import re
from functools import cache

import numpy as np
import pytest

from trendloom.llm import line_dedup, passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hashed(words, starts=()):
    """The words of a text whose lines begin at these words."""
    return passages.Words(["".join(("\n" if k in starts else " ") * (k > 0) + w for k, w in enumerate(words)).encode()])


def selected(lines):
    """(key, first word, words) of the selected grams, by looking at every window; `lines` are the word lists of a text."""
    words = [w for line in lines for w in line]
    if not words:
        return set()
    h = hashed(words)
    key = cache(lambda a, b: int(h.keys(np.array([a]), np.array([b]))[0]))
    starts = [sum(map(len, lines[:i])) for i in range(len(lines))] + [len(words)]
    out, size = set(), min(passages.LINE_WINDOW, len(words))
    grams = [(starts[i], next((e for e in starts[i + 1 :] if e - starts[i] >= passages.LINE_GRAM), None)) for i in range(len(lines))]
    for i in range(len(lines)):
        ahead = next((e for e in starts[i + 1 :] if e - starts[i] >= size), None)
        back = next((s for s in reversed(starts[: i + 1]) if starts[i + 1] - s >= size), None)
        for a, b in ((starts[i], ahead), (back, starts[i + 1])):
            inside = [(key(*g), g[0], g[1] - g[0]) for g in grams if None not in (a, b) and a <= g[0] and g[1] is not None and g[1] <= b]
            if inside:
                k, at, n = min(inside, key=lambda g: (g[0] ^ int(passages.LINES), g[1]))
                out.add(("lines", k, at, n))
    for a in range(len(words) - passages.PASSAGE_WORDS + 1):
        k, at = min((key(x, x + passages.WORD_GRAM), x) for x in range(a, a + passages.PASSAGE_WORDS - passages.WORD_GRAM + 1))
        out.add(("words", k, at, passages.WORD_GRAM))
    return out


def brute(rows):
    """Texts after dedup, by the definitions, one document and one word at a time."""
    texts = {i: t for i, t in rows}
    lines = {i: [WORD.findall(x) for x in (t or "").split("\n")] for i, t in texts.items()}
    words = {i: [w for line in x for w in line] for i, x in lines.items()}
    chosen = {i: selected([x for x in v if x]) for i, v in lines.items()}
    first = {}
    for i in sorted(chosen):
        for kind, k, at, _ in sorted(chosen[i], key=lambda x: x[2]):
            first.setdefault((kind, k), (i, at))
    out = {}
    for i, t in texts.items():
        gone, merged = set(), []
        for at, j, o, until in sorted((at, *first[kind, k], at + n) for kind, k, at, n in chosen[i] if first[kind, k] != (i, at)):
            size = until - at
            if merged and at <= merged[-1][1]:
                merged[-1][1:4] = max((merged[-1][1], merged[-1][3]), (until, (j, o + until - at)))[0], merged[-1][2], max((merged[-1][1], merged[-1][3]), (until, (j, o + until - at)))[1]
            else:
                merged.append([at, until, (j, o), (j, o + until - at), max(0, o + size - at) if j == i else 0])
        for a, b, (j, o), (m, q), lead in merged:
            lowest, highest = a - line_dedup.REACH, b + line_dedup.REACH
            while a > max(lowest, 0) and o > 0 and words[i][a - 1] == words[j][o - 1]:
                a, o = a - 1, o - 1
            while b < min(highest, len(words[i])) and q < len(words[m]) and words[i][b] == words[m][q]:
                b, q = b + 1, q + 1
            a += lead
            if b - a >= passages.PASSAGE_WORDS:
                gone |= set(range(a, b))
            else:
                at, whole = 0, set()
                for line in lines[i]:
                    if line and a <= at and at + len(line) <= b:
                        whole |= set(range(at, at + len(line)))
                    at += len(line)
                gone |= whole if len(whole) >= passages.LINE_GRAM else set()
        out[i] = [w for k, w in enumerate(words[i]) if k not in gone]
    return out


def deduped(df):
    return {r.row.doc_id: r for r in line_dedup.dedup_lines(df).collect()}


def test_against_brute_force(docs):
    r = random.Random(6)
    own = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    lines = [own(n) for n in (1, 1, 2, 3, 3, 4, 7, 8, 9, 9, 12, 15, 24, 25, 30, 49, 50, 70)]
    rows = []
    for k in range(70):
        parts = []
        for _ in range(r.randint(0, 12)):
            line = r.choice(lines).split()
            a = r.randint(0, 3) if r.random() < 0.3 else 0
            parts.append(own(r.randint(1, 9)) if r.random() < 0.2 else " ".join(line[a : len(line) - a]) + r.choice(("", " ")))
            parts.append(r.choice(("\n", "\n", "\n\n", " ")))
        rows.append((k, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, "\n".join(lines * 4)), (104, "again " * 90), (105, own(400).replace(" ", "\n"))]
    got, want = deduped(docs(rows)), brute(rows)
    assert {k: WORD.findall(x.new_text or "") for k, x in got.items()} == want
    assert (got[100].new_text, got[100].n_lines, got[100].n_removed) == (None, 0, 0) and (got[102].new_text, got[102].n_lines) == ("\n \n", 3)
    assert sum(x.n_removed for x in got.values()) > 100 and sum(map(len, want.values())) > 1000


@pytest.mark.parametrize("period", [1, 2, 7, 24, 25, 40, 60])
@pytest.mark.parametrize("lines", [False, True])
def test_texts_that_repeat_themselves_keep_a_first_occurrence(docs, prose, period, lines):
    """p words over and over keep the first p, or a gram where that is more; on lines of p words, the lines of the first gram."""
    words = [f"w{k}" for k in range(period)]
    turns = 400 // period
    text = ("\n" if lines else " ").join([" ".join(words)] * turns)
    [got] = line_dedup.dedup_lines(docs([(1, text)])).collect()
    kept = max(period, passages.LINE_GRAM + -passages.LINE_GRAM % period) if lines else max(period, passages.WORD_GRAM)
    assert WORD.findall(got.new_text) == (words * turns)[:kept] or lines and WORD.findall(got.new_text) == (words * turns)[: max(period, passages.WORD_GRAM)]
    other = line_dedup.dedup_lines(docs([(1, text), (2, prose("en", 30) + "\n" + text)])).where("row.doc_id = 2").collect()[0]
    assert WORD.findall(other.new_text) == WORD.findall(other.new_text)[:30]  # a later document keeps none of it


def test_found_by_fingerprints_alone(docs, prose, monkeypatch):
    """A short repeated line counts only where its window selects it, and without fingerprints nothing is found."""
    line = "this line of nine words stands in many texts"
    rows = [(k, f"{prose('en', 9)}\n{line}\n{prose('en', 9)}") for k in range(40)]
    chosen = [k for k, t in rows if any(n == 9 and at == 9 for _, at, n in zip(*(x.tolist() for x in passages.fingerprints([t.encode()])[1:]), strict=True))]
    assert 5 < len(chosen) < 35
    got = deduped(docs(rows))
    assert [k for k, t in rows if line not in got[k].new_text] == chosen[1:]
    whole = line_dedup.fingerprints
    monkeypatch.setattr(line_dedup, "fingerprints", lambda df: whole(df).where("doc_id < 0"))
    assert line_dedup.repeated_runs(docs(rows)).count() == 0


def test_fewer_fingerprints_than_lines_and_guarantee(prose):
    """Of two texts that share a run of lines with LINE_WINDOW words, both select a gram at the same place of it."""
    r = random.Random(4)
    lines = lambda n: [prose("en", r.randint(1, 14)) for _ in range(n)]
    n_lines = n_chosen = 0
    for _ in range(60):
        a, b, shared = lines(6), lines(9), lines(4)
        while sum(len(x.split()) for x in shared) < passages.LINE_WINDOW:
            shared += lines(1)
        places = []
        for head in (a, b):
            text = "\n".join([*head, *shared, *lines(5)])
            n = sum(len(x.split()) for x in head)
            key, at, _ = passages.select_lines(passages.Words([text.encode()]))
            places.append({(k, p - n) for k, p in zip(key.tolist(), at.tolist(), strict=True) if p >= n})
            n_lines, n_chosen = n_lines + text.count("\n") + 1, n_chosen + len(key)
        assert places[0] & places[1]
    assert n_chosen < 0.6 * n_lines


def test_short_repeats_stay_and_passages_go_whole(docs, prose):
    passage, common = prose("en", 60), "All rights reserved."
    rows = [(1, f"one\n{common}\n{passage}\nend"), (2, f"{common}\n{passage}\nother"), (3, f"{common}\nmine")]
    got = {r.doc_id: r.text for r in line_dedup.documents_without_repeats(docs(rows)).collect()}
    # what stands before the passage in both texts is part of the run
    assert got == {1: rows[0][1], 2: "other", 3: rows[2][1]}


def test_passage_from_mid_line_to_mid_line_goes(docs, prose):
    passage = prose("en", 54).split()
    inner = [" ".join(passage[:15]), " ".join(passage[15:39]), " ".join(passage[39:])]  # the sole whole line has 24 words
    text = lambda a, b: f"{a} {inner[0]}\n{inner[1]}\n{inner[2]} {b}"
    rows = [(1, text("one begins", "ends one")), (2, text("  two  starts", "then  two ")), (3, "three " + " ".join(passage[:49]) + " stays")]
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.documents_without_repeats(docs(rows)).collect()}
    assert got[1] == (rows[0][1], len(rows[0][1])) and got[3][0] == rows[2][1]
    assert got[2] == ("  two  starts\nthen  two ", 24)


def test_every_planted_passage_goes_and_own_words_stay(docs):
    r = random.Random(12)
    own = lambda n: [f"own{r.randint(0, 10**9)}" for _ in range(n)]
    pool = [own(n) for n in (50, 51, 60, 75, 120, 400)]
    rows, clean = [], {}
    for k in range(60):
        words = []
        for p in r.sample(pool, r.randint(0, 3)):
            words += own(r.randint(0, 40)) + p
        words += own(r.randint(0, 60))
        clean[k] = [w for w in words if not any(w in p for p in pool)]
        rows.append((k, "".join(w + (" " if r.random() < 0.9 else "\n") for w in words)))
    got = {k: WORD.findall(x.new_text) for k, x in deduped(docs(rows)).items()}
    seen = set()
    for k, t in rows:
        here = [i for i, p in enumerate(pool) if p[0] in t.split()]
        assert [w for w in got[k] if w.startswith("own") and not any(w in p for p in pool)] == clean[k]
        for i in here:
            assert (sum(w in pool[i] for w in got[k]) == len(pool[i])) == (i not in seen)
            assert i not in seen or not any(w in pool[i] for w in got[k])
        seen |= set(here)


def test_columns_repeated_rows_and_nulls(docs, prose):
    text = prose("en", 60)
    df = docs([(2, text), (2, text), (5, text), (None, "x"), (7, None)])
    out = line_dedup.documents_without_repeats(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.where("doc_id <> 7 OR doc_id IS NULL").collect())
    assert got == [(0, "x", 1), (2, text, len(text)), (2, text, len(text)), (5, "", 0)]
    assert line_dedup.documents_without_repeats(docs([])).count() == 0


def test_unlike_texts_of_one_id_and_null_ids(docs, prose):
    text = prose("en", 60)
    got = [r.text for r in line_dedup.documents_without_repeats(docs([(1, "own words here"), (1, text), (None, text), (3, text + " end")])).collect()]
    assert sorted(got) == sorted(["own words here", "", text, "end"])


def test_very_long_texts(docs, prose):
    body = prose("en", 150_000)
    blob = "x" * 1_500_000
    got = deduped(docs([(1, body), (2, "head\n" + body + "\ntail"), (3, blob), (4, blob)]))
    assert got[1].new_text == body and WORD.findall(got[2].new_text) == ["head", "tail"]
    assert got[3].new_text == got[4].new_text == blob  # one word is no run


def test_keys_depend_on_the_words_alone():
    words = [f"w{k}" for k in range(300)]
    whole = hashed(words, {7, 90})
    for k in (1, 25, 50, 300):
        at = np.arange(301 - k)
        assert whole.keys(at, at + k).tolist() == [int(hashed(words[a : a + k]).keys(np.array([0]), np.array([k]))[0]) for a in at]
    assert len(set(passages.Words([("ab c " * 300_000).encode()]).hashes.tolist())) == 2


def test_texts_together_give_what_each_gives_alone(prose):
    r = random.Random(3)
    texts = ["".join(w + r.choice("      \n") for w in prose("en", r.randint(0, 200)).split()).encode() for _ in range(40)] + [b"", b"\n \n", b"x"]
    rows = sorted(zip(*(x.tolist() for x in passages.fingerprints(texts)), strict=True))
    assert rows == sorted((i, *x[1:]) for i, t in enumerate(texts) for x in zip(*(y.tolist() for y in passages.fingerprints([t])), strict=True))
    asks = [[0, 1, 3, 6] if len(t) > 20 else [] for t in texts]
    alone = [x.tolist() for t, a in zip(texts, asks, strict=True) for x in passages.contexts([t], [a], 5)]
    assert [x.tolist() for x in passages.contexts(texts, asks, 5)] == alone
