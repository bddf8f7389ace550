"""Normalisation of names and addresses as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarn.functions import words as W

NUMBER = r"\d+[a-zA-Z]?"


@lru_cache(maxsize=1)
def _latin() -> tuple[str, str, dict[str, str]]:
    """Precomposed characters of the Latin blocks and their base letters; those of several letters apart."""
    one, many = {}, {}
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            one[c] = base
        elif base != c and base:
            many[c] = base
    return "".join(one), "".join(one.values()), many


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def remove_accents(c: Column, exact: bool = False) -> Column:
    """Compatibility decomposition without combining marks; null gives "".

    By default inside the JVM: a translation table of the Latin and full-width blocks, then marks are dropped. exact decomposes
    every script, in Arrow batches.
    """
    c = F.coalesce(c, F.lit(""))
    if exact:
        return _nfkd(c)
    source, target, many = _latin()
    c = F.translate(c, source, target)
    for k in "ﬁﬂ½¼¾…™":
        if k in many:
            c = F.replace(c, F.lit(k), F.lit(many[k]))
    return F.regexp_replace(c, r"\p{Mn}+", "")


def normalize_text(c: Column, exact: bool = False) -> Column:
    """Without accents, lower case, punctuation as spaces, single spaces. Underscores stay. Null gives ""."""
    t = F.regexp_replace(F.lower(remove_accents(c, exact)), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """White-space tokens, without the empty one that splitting "" gives."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def expand_abbreviations(c: Column, table: dict[str, str]) -> Column:
    """Each token replaced by its long form, once; others as they are."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(tokens(c), lambda t: F.coalesce(F.try_element_at(m, t), t)), " ")


def normalize_name(c: Column, exact: bool = False) -> Column:
    return expand_abbreviations(normalize_text(c, exact), W.NAME_ABBREVIATIONS)


def normalize_address(c: Column, exact: bool = False) -> Column:
    return expand_abbreviations(normalize_text(c, exact), W.ADDRESS_ABBREVIATIONS)


def normalize_v1(c: Column) -> Column:
    """First generation: one dictionary for names and addresses."""
    return expand_abbreviations(normalize_text(c), W.V1_ABBREVIATIONS)


def normalize_key(c: Column) -> Column:
    """Key-only matcher: its own small dictionary."""
    return expand_abbreviations(normalize_text(c), W.KEY_ABBREVIATIONS)


def normalize_plain(c: Column) -> Column:
    """Diagnostics: lower case and single spaces only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def normalize_experiment(c: Column) -> Column:
    """Reserve experiment: lower case without punctuation, accents kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def normalize_diagnostic(c: Column, table: dict[str, str]) -> Column:
    """Diagnostics with their own dictionaries: composed, then decomposed compatibly, which gives the same as decomposing once."""
    return expand_abbreviations(normalize_text(c), table)


def extract_postal(c: Column, digits: tuple[int, int] = (5, 5), last: bool = False) -> Column:
    """First (or last) run of the given number of digits in the raw address, with or without four more; "" when none."""
    low, high = digits
    run = rf"\d{{{low}}}" if low == high else rf"\d{{{low},{high}}}"
    c = F.coalesce(c, F.lit(""))
    if last:
        return F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(rf"(?U)\b({run})\b"), F.lit(1)), F.lit(-1)), F.lit(""))
    plus = r"(?:-?\d{4})?" if low == high else r"(?:-\d{4})?"
    return F.regexp_extract(c, rf"(?U)\b({run}){plus}\b", 1)


def country_key(c: Column) -> Column:
    """Trimmed and lower-cased; null gives "nan", so that records without a country block together."""
    return F.coalesce(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit("nan"))


def first_token(c: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens(c), F.lit(1)), F.lit(""))


def last_token(c: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens(c), F.lit(-1)), F.lit(""))


def sorted_tokens(c: Column) -> Column:
    """All tokens, repeats too, in order of code points."""
    return F.array_join(F.array_sort(tokens(c)), " ")


def without(c: Column, drop: list[str]) -> Column:
    """Tokens that are not in drop, in their order."""
    return F.array_join(F.filter(tokens(c), lambda t: ~t.isin(drop)), " ")


def core_tokens(c: Column, legal: list[str] = W.LEGAL) -> Column:
    return sorted_tokens(without(c, legal))


def strip_legal(c: Column) -> Column:
    return without(c, W.LEGAL_SUFFIXES)


def street_number(c: Column) -> Column:
    """First run of two to five digits of a normalised address."""
    return F.regexp_extract(c, r"(?U)(\b\d{2,5}\b)", 1)


def number_and_token(c: Column) -> Column:
    """number|tok4: the first number of two digits or more, and four letters of the first telling word among the next four
    tokens; "" when either is missing. Later numbers are not tried."""
    t = F.regexp_extract_all(F.lower(c), F.lit(rf"{NUMBER}|[a-zA-Z]+"), F.lit(0))
    at = F.array_position(F.transform(t, lambda x: x.rlike(rf"^\d{{2,}}[a-zA-Z]?$")), True)
    telling = F.filter(F.slice(t, at.cast("int") + 1, 4), lambda x: x.rlike("^[a-z]{3,}$") & ~x.isin(W.GENERIC))
    found = (at > 0) & (F.size(telling) > 0)
    return F.when(found, F.concat_ws("|", F.try_element_at(t, F.greatest(at.cast("int"), F.lit(1))), F.substring(F.try_element_at(telling, F.lit(1)), 1, 4))).otherwise("")


def id_list(c: Column, trimmed: bool = True) -> Column:
    """Distinct ids of a comma-joined list; null and "" give none."""
    parts = F.split(F.coalesce(c, F.lit("")), ",")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)) if trimmed else parts, lambda x: x != ""))
