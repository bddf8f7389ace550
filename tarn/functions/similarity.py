"""Similarity of string pairs: token measures as Column expressions, edit measures in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tarn.functions.text import first_token, last_token, sorted_tokens, token_set


def jaccard(a: Column, b: Column) -> Column:
    x, y = token_set(a), token_set(b)
    n = F.size(F.array_union(x, y))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(n, F.lit(1)))


def common_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(token_set(a), token_set(b)))


def token_overlap(a: Column, b: Column) -> Column:
    n = F.least(F.size(token_set(a)), F.size(token_set(b)))
    return F.when(n == 0, 0.0).otherwise(common_tokens(a, b) / F.greatest(n, F.lit(1)))


def token_diff_count(a: Column, b: Column) -> Column:
    x, y = token_set(a), token_set(b)
    return F.size(F.array_union(x, y)) - F.size(F.array_intersect(x, y))


def token_count_diff(a: Column, b: Column) -> Column:
    return F.abs(F.size(token_set(a)) - F.size(token_set(b)))


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.length(a), F.length(b)
    return F.when((x == 0) | (y == 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y, F.lit(1)))


def both_equal(a: Column, b: Column) -> Column:
    """1 when both are given and equal, else 0."""
    return ((a != "") & (b != "") & (a == b)).cast("int")


def first_token_match(a: Column, b: Column) -> Column:
    return both_equal(first_token(a), first_token(b))


def last_token_match(a: Column, b: Column) -> Column:
    return both_equal(last_token(a), last_token(b))


def _masks(a: str) -> dict[str, int]:
    """Where each character of a stands, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _common(masks: dict[str, int], n: int, b: str) -> int:
    full = (1 << n) - 1
    s = full
    for c in b:
        if m := masks.get(c):
            u = s & m
            s = (s + u | s - u) & full
    return n - s.bit_count()


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: all of a in one integer of bits, a few operations per character of b."""
    return _common(_masks(a), len(a), b) if a and b else 0


def ratio(a: str, b: str) -> float:
    """Normalised insert/delete similarity; 1.0 for two empty strings."""
    n = len(a) + len(b)
    return 2 * lcs_length(a, b) / n if n else 1.0


def _sorted(t: str) -> str:
    return " ".join(sorted(t.split()))


def set_ratio(a: str, b: str) -> float:
    """Similarity of token sets: 0 if one is empty, 1 if one holds the other, else the best of three comparisons."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = x & y
    if shared and (x <= y or y <= x):
        return 1.0
    p, q = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    s = len(" ".join(sorted(shared)))
    gap = 1 if s else 0
    left, right = s + gap + len(p), s + gap + len(q)
    best = 1 - (len(p) + len(q) - 2 * lcs_length(p, q)) / (left + right)
    if s:
        best = max(best, 1 - (gap + len(p)) / (s + left), 1 - (gap + len(q)) / (s + right))
    return best


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of its length in the longer, or with a shorter window at an end."""
    if not a or not b:
        return 1.0 if a == b else 0.0

    def windows(short: str, long: str) -> float:
        n = len(short)
        if short in long:
            return 1.0
        masks = _masks(short)
        most, i = 0, 0
        while i <= len(long) - n:
            common = _common(masks, n, long[i : i + n])
            most = max(most, common)
            i += most + 1 - common  # a step changes the common length by one at most
        best = most / n
        for k in range(n - 1, 0, -1):
            if 2 * k / (n + k) <= best:  # a shorter window can't score more
                break
            best = max(best, 2 * max(_common(masks, n, long[:k]), _common(masks, n, long[-k:])) / (n + k))
        return best

    if len(a) == len(b):
        return max(windows(a, b), windows(b, a))
    return windows(a, b) if len(a) < len(b) else windows(b, a)


def _kernel(f, name: str, guarded: bool):
    """guarded: 0.0 when either string is empty."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(a, b):
            if p not in seen:
                x, y = p[0] or "", p[1] or ""
                seen[p] = 0.0 if guarded and not (x and y) else f(x, y)
            out.append(seen[p])
        return pd.Series(out, dtype="float64")

    run.__name__ = name
    return run


def indel_ratio(a: Column, b: Column, guarded: bool = True) -> Column:
    return _kernel(ratio, "indel_ratio", guarded)(a, b)


def token_sort_ratio(a: Column, b: Column, guarded: bool = True) -> Column:
    return _kernel(ratio, "token_sort_ratio", guarded)(sorted_tokens(a), sorted_tokens(b))


def token_set_ratio(a: Column, b: Column, guarded: bool = True) -> Column:
    return _kernel(set_ratio, "token_set_ratio", guarded)(a, b)


def partial_ratio(a: Column, b: Column, guarded: bool = True) -> Column:
    return _kernel(partial, "partial_ratio", guarded)(a, b)


def lcs_sql(a: str, b: str) -> Column:
    """Longest common subsequence inside the JVM, as a check of the kernel: quadratic, for short strings."""
    step = f"aggregate(sequence(1, length({b})), array(0), (cur, j) -> concat(cur, array(if(substring({b}, j, 1) = ca, prev[j - 1] + 1, greatest(prev[j], element_at(cur, -1))))))"
    return F.expr(f"if({a} = '' or {b} = '', 0, aggregate(split({a}, ''), array_repeat(0, length({b}) + 1), (prev, ca) -> {step}, r -> element_at(r, -1)))")
