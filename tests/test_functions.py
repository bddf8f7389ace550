"""Scalar functions and similarity kernels against plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tarn.functions import similarity as S
from tarn.functions import text as T


def one(spark, text, *columns):
    df = spark.createDataFrame([(text,)], "t string")
    return tuple(df.select(*[c(F.col("t")).alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    "text,name",
    [
        (None, ""), ("  ", ""), ("Café & Co. S.A.R.L.", "cafe company s a r l"), ("a_b-c", "a_b c"), ("तमिल", "तम ल"), ("Müller  Bros", "muller brothers"), ("Ste. Corp", "societe corporation"),
    ],
)
def test_normalize_name(spark, text, name):
    assert one(spark, text, T.normalize_name, lambda c: T.normalize_name(c, exact=True)) == (name, name)


def test_normalize_text_as_python(spark):
    import re

    texts = ["Élan Vital!", "ＡＢＣ　１２", "naïve—test", "ﬁne ½ ok", "İstanbul", "Ωmega µ", "x" * 50_000, "tab\there", "a​b"]
    want = []
    for t in texts:
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        want.append(re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t)).strip())
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.normalize_text(F.col("t"), exact=True)).collect()] == want


@pytest.mark.parametrize("text,code", [("12345-6789", "12345"), ("123456789", "12345"), ("560001", ""), (None, ""), ("no", ""), ("x 54321, 12345", "54321")])
def test_postal(spark, text, code):
    assert one(spark, text, T.extract_postal) == (code,)


def test_postal_options(spark):
    assert one(spark, "110001 and 12345", lambda c: T.extract_postal(c, (5, 6)), lambda c: T.extract_postal(c, (5, 5), last=True)) == ("110001", "12345")


@pytest.mark.parametrize("text,key", [("12th main", "12t|main"), ("5 oak road", ""), ("120 north road", ""), ("12 elm 345", "12|elm"), ("", ""), (None, "")])
def test_number_and_token(spark, text, key):
    assert one(spark, text, lambda c: T.number_and_token(T.normalize_address(c))) == (key,)


def test_keys_of_edge_names(spark):
    assert one(spark, "Ltd Inc", lambda c: T.core_tokens(T.normalize_name(c))) == ("",)
    assert one(spark, None, T.country_key) == ("nan",)
    assert one(spark, "b a b", T.sorted_tokens, T.first_token, T.last_token) == ("a b b", "b", "b")
    assert one(spark, "", T.sorted_tokens, T.first_token, T.last_token) == ("", "", "")
    assert one(spark, "a, b,,a ", T.id_list) == (["a", "b"],)
    assert one(spark, "12 elm 345", T.street_number) == ("12",)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_kernels_against_brute_force(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abc de") for _ in range(r.randint(0, n)))
    pairs = [(word(14), word(20)) for _ in range(300)]
    for a, b in pairs:
        assert S.lcs_length(a, b) == lcs(a, b)
        s, l = sorted((a, b), key=len)
        if s:
            n = len(s)
            windows = [l[i : i + n] for i in range(len(l) - n + 1)] + [l[:k] for k in range(1, n)] + [l[-k:] for k in range(1, n)]
            best = max(S.ratio(s, w) for w in windows)
            if len(s) == len(l):
                best = max(best, *[S.ratio(l, w) for w in [s, *[s[:k] for k in range(1, n)], *[s[-k:] for k in range(1, n)]]])
            assert S.partial(a, b) == pytest.approx(best)
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [x[0] for x in df.select(S.lcs_sql("a", "b")).collect()] == [lcs(a, b) for a, b in pairs]
    got = df.select(S.indel_ratio(F.col("a"), F.col("b")), S.token_sort_ratio(F.col("a"), F.col("b"), False), S.token_set_ratio(F.col("a"), F.col("b"))).collect()
    for (a, b), (x, y, z) in zip(pairs, got):
        assert x == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)
        assert 0 <= y <= 1 and 0 <= z <= 1


def test_set_ratio_known_answers():
    assert S.set_ratio("a b", "b a") == 1.0 and S.set_ratio("a b", "a b c") == 1.0 and S.set_ratio("", "a") == 0.0
    assert S.set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert S.ratio("", "") == 1.0 and S.partial("", "") == 1.0 and S.partial("", "a") == 0.0


def test_token_measures(spark):
    df = spark.createDataFrame([("rajani enterprises of kannur", "rajani enterprises kannur of"), ("", "a"), ("", "")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(S.jaccard(a, b), S.common_tokens(a, b), S.first_token_match(a, b), S.last_token_match(a, b), S.token_overlap(a, b), S.length_ratio(a, b), S.token_diff_count(a, b), S.token_count_diff(a, b)).collect()
    assert tuple(got[0]) == (1.0, 4, 1, 0, 1.0, 1.0, 0, 0)
    assert tuple(got[1]) == (0.0, 0, 0, 0, 0.0, 0.0, 1, 1) and tuple(got[2]) == (0.0, 0, 0, 0, 0.0, 0.0, 0, 0)
