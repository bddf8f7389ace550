"""Encoding, one form of look-alike text, and leaks: round trips, known answers, brute force."""

import random

import pytest

from tarn.llm import leaks as K
from tarn.llm import lookalike as A
from tarn.llm import tokenize as T
from tarn.llm.words import words

WORDS = [None, "", " ", "hello world", "<|endoftext|> x", "don't 'S stop", "  \n\n x\t", "日本語 テスト 123", "é é ½²", "a\x1cb\x1d", "naïve 🙂🙂 ok", "x" * 3000, "ab" * 40_000]


def test_encoding_equals_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(T.vocabulary("byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    df = spark.createDataFrame([(i, w, 7) for i, w in enumerate(WORDS)] + [(None, "hi", 1)], "doc_id long, text string, ids int")
    rows = T.encode_corpus(df, "doc_id", "text").collect()
    got = {r["doc_id"]: r["ids"] for r in rows}
    assert len(rows) == len(WORDS) + 1 and got[0] == [] == got[1]
    for i, w in enumerate(WORDS):
        if w:
            assert got[i] == ref.encode(w, add_special_tokens=False).ids, w[:20]
    back = {r["doc_id"]: r["text"] for r in T.decode_corpus(T.encode_corpus(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert all(back[i] == (w or "") for i, w in enumerate(WORDS))
    assert T.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_random_bytes_round_trip():
    ref = pytest.importorskip("tokenizers").Tokenizer.from_file(T.vocabulary("byte_bpe_50k.json"))
    own, r = T.tokenizer(T.vocabulary()), random.Random(3)
    for _ in range(300):
        text = "".join(chr(r.choice([32, 10, 39, 97, 115, 48, 0x301, 0x1F600, 0xBD, 0x660, 0x3000, 0x85, 0x200B, r.randrange(33, 1000)])) for _ in range(r.randint(0, 60)))
        assert own.encode(text) == ref.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)) == text


ALIKE = [
    ("plain text", "ｐｌａｉｎ　ｔｅｘｔ"), ("café", "café"), ("cape", "саре"), ("a b", "a b"), ("word", "wo​rd"), ("soft", "so­ft"), ("fine", "ﬁne"), ("a-b", "a‑b"),
    ("K Ω", "K Ω"), ("x\ny", "x\r\ny"), ("ë", "ё"), ("é", "е‍́"),
]
ALIKE += [
    ("aikpvuyo", "αικρνυγο"), ("ag", "ɑɡ"), ("l l", "ӏ ⅼ"), ("IV viii", "Ⅳ ⅷ"), ("SU", "ՏՍ"), ("DRT", "ᎠᎡᎢ"), ("bold", "𝐛𝐨𝐥𝐝"), ("R", "ℝ"), ("カガ", "ｶｶﾞ"), ("st st", "ﬅ ﬆ"), ("DŽ", "Ǆ"), ("PC", "ⲢⲤ"), ("金", "⾦"), ("x\ny", "x\ry"), ("لا", "ﻻ"),
]
DIFFERENT = [("text", "Text"), ("cafe", "café"), ("x2", "x²"), ("1/2", "½"), ("word", "words"), ("a b", "ab"), ("0", "O"), ("к", "k"), ("1", "①"), ("2", "₂"), ("...", "…"), ("a", "ª"), ("kg", "㎏")]


def test_forms(spark):
    rows = [(2 * i, a) for i, (a, _) in enumerate(ALIKE + DIFFERENT)] + [(2 * i + 1, b) for i, (_, b) in enumerate(ALIKE + DIFFERENT)]
    form = {r["k"]: r["text"] for r in A.one_form(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    for i, pair in enumerate(ALIKE):
        assert form[2 * i] == form[2 * i + 1] == pair[0], pair
    for i in range(len(ALIKE), len(ALIKE + DIFFERENT)):
        assert form[2 * i] != form[2 * i + 1], DIFFERENT[i - len(ALIKE)]


def test_look_alike_pairs(spark):
    rows = [(1, "same text"), (2, "same text"), (3, "same tеxt"), (4, None), (5, ""), (6, "  "), (7, " "), (8, "other"), (9, "Same text"), (10, "ѕame text"), (11, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS form", "2 AS exact")
    got = {tuple(r) for r in A.look_alike_pairs(df, "doc_id", "text").collect()}
    assert got == {(1, 3), (2, 3), (1, 10), (2, 10), (3, 10)}
    assert A.look_alike_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_words_of_layouts():
    import json

    cell = "The *quick* brown\nfox, café"
    want = ["the", "quick", "brown", "fox", "café"]
    book = json.dumps({"cells": [{"cell_type": "markdown", "metadata": {}, "source": [x + "\n" for x in cell.split("\n")]}]}, indent=1)
    for text in (cell, book, f"# %% [markdown]\n# {cell}", f"In [3]:\n{cell}", f"```python\n{cell}\n```", "Ｔｈｅ quick​ brown fox, café", book[:-3]):
        assert [w for w in words(text) if w not in ("cells", "cell", "type", "markdown", "metadata", "source")] == want, text
    assert words(None) == [] == words("")


def sentence(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [f"{a}{b}" for a in ("bar", "lom", "tiv", "gran", "pel", "sor", "dun", "wick", "hal", "mer") for b in ("el", "ock", "ine", "und", "ast", "iver")]


def test_leaks_against_brute_force(spark):
    r = random.Random(11)
    bodies = [sentence(r, r.randint(40, 70)) for _ in range(20)]
    items = [(i, f"Read this and answer. {b}", "42") for i, b in enumerate(bodies)] + [(90, None, None), (91, "", "x"), (92, "Read this and answer.", "y")]
    docs, want = [(1000, None), (1001, ""), (1002, " "), (1003, "Read this and answer. " * 30)], set()
    for d in range(120):
        text = sentence(r, r.randint(0, 300)).split()
        if d % 3 == 0:
            i = r.randrange(20)
            w = bodies[i].split()
            n = r.choice([10, 16, 24, 30, len(w)])
            at = r.randint(0, len(w) - n)
            piece = w[at : at + n]
            if n >= 24:
                want.add((d, i))
                for k in range(4, n - 3, 9):
                    piece[k] = "changed" if d % 2 else ""
            where = r.randint(0, len(text))
            text[where:where] = piece
        docs.append((d, ", ".join(x for x in text if x).upper() if d % 5 == 0 else " ".join(x for x in text if x)))
    docs += [(2000, docs[4][1]), (3000, " ".join([docs[7][1]] * 200))]
    want |= {(2000, i) for d, i in want if d == docs[4][0]} | {(3000, i) for d, i in want if d == docs[7][0]}
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS ids", "'z' AS answers", "2 AS item")
    out = K.find_leaks(frame, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string, answer string"), "item_id", "text", "answer").collect()
    got = {(x["doc_id"], x["item"]) for x in out}
    assert len(out) == len(got)
    assert got == want
    assert all(x["matched_words"] >= 21 and x["cosine"] >= K.COSINE for x in out)


def test_items_of_one_sentence_short_items_and_paraphrases(spark):
    r = random.Random(5)
    one, short, long = sentence(r, 40) + ".", sentence(r, 12), sentence(r, 48)
    changed = [w if i % 5 else "changed" for i, w in enumerate(long.split())]
    items = [(1, one, None), (2, f"Read this. {short}", None), (3, f"Read this. {long}", "forty two"), (4, "Read this.", "x"), (5, "Read this.", "y")]
    docs = [(1, one), (2, "some other words " + short + " and so on"), (3, " ".join([*changed, "the answer is forty two"])), (4, " ".join(changed)), (5, "Read this. " * 20)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, answer string")
    strict = {(x["doc_id"], x["item"]) for x in K.find_leaks(d, "doc_id", "text", i, "item_id", "text", "answer").collect()}
    loose = {(x["doc_id"], x["item"]) for x in K.find_leaks(d, "doc_id", "text", i, "item_id", "text", "answer", cosine=0.5, answered=4).collect()}
    assert strict == {(1, 1), (2, 2)} and loose == {(1, 1), (2, 2), (3, 3)}


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "One. " + sentence(random.Random(1), 30))], "item_id long, text string")
    assert K.find_leaks(docs, "doc_id", "text", items, "item_id", "text").count() == 0
    assert K.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert K.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        assert K.longest_common(a, b) == row[-1]
