"""Similarity of strings: 100 * 2 * LCS / (both lengths), on tokens put in order for titles.

Two empty strings count as equal (100).  Thresholds compare whole numbers, so no rounding decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType


def sorted_tokens(title: Column) -> Column:
    """The words of a normalised title in order; repeated words stay, null stays null."""
    return F.array_join(F.array_sort(F.split(title, " ")), " ")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; bits of one integer stand for the places of ``a``."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS lengths; equal pairs of a batch are computed once."""
    known: dict[tuple[str, str], int] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = lcs_length(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="int32")


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: The place of each byte's count; what is no small letter or digit counts as one kind.
_PLACE = np.array([_LETTERS.find(chr(b)) if chr(b) in _LETTERS else len(_LETTERS) for b in range(256)])


@F.pandas_udf(BinaryType())
def letter_counts(text: pd.Series) -> pd.Series:
    """How often each letter and digit is there, and all else, as 32-bit numbers; see ``lcs_reaching``."""
    count = lambda t: np.bincount(_PLACE[np.frombuffer(t.encode("latin-1", "replace"), dtype=np.uint8)], minlength=len(_LETTERS) + 1)
    return pd.Series([count(t).astype("<u4").tobytes() for t in text], dtype=object)


def lcs_reaching(threshold: float):
    """A function of two texts and their ``letter_counts``: LCS lengths, or 0 where the letters alone rule ``threshold`` out."""

    @F.pandas_udf(IntegerType())
    def reaching(a: pd.Series, b: pd.Series, in_a: pd.Series, in_b: pd.Series) -> pd.Series:
        counts = [np.frombuffer(b"".join(x), dtype="<u4").reshape(-1, len(_LETTERS) + 1).astype(np.int64) for x in (in_a, in_b)]
        may = 200 * np.minimum(*counts).sum(axis=1) >= threshold * (counts[0].sum(axis=1) + counts[1].sum(axis=1))
        out = np.zeros(len(a), dtype=np.int32)
        known: dict[tuple[str, str], int] = {}
        for i in np.flatnonzero(may).tolist():
            pair = a.iat[i], b.iat[i]
            if pair not in known:
                known[pair] = lcs_length(*pair)
            out[i] = known[pair]
        return pd.Series(out)

    return reaching


def lcs_native(a: Column, b: Column) -> Column:
    """The same by higher-order functions alone, for short strings or where Python is unwelcome."""
    start = F.array_repeat(F.lit(0), F.length(b) + 1)
    places = F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b))).otherwise(F.array().cast("array<int>"))

    def cell(row: Column, x: Column):
        def step(done: Column, j: Column) -> Column:
            diagonal = F.when(F.substr(b, j, F.lit(1)) == x, F.element_at(row, j) + 1).otherwise(0)
            return F.concat(done, F.array(F.greatest(F.element_at(row, j + 1), F.element_at(done, -1), diagonal)))

        return step

    letters = F.filter(F.split(a, ""), lambda c: c != "")
    last = F.aggregate(letters, start, lambda row, x: F.aggregate(places, F.array(F.lit(0)), cell(row, x)))
    return F.element_at(last, -1)


def at_least(common: Column, a: Column, b: Column, threshold: float) -> Column:
    """Whether a subsequence of ``common`` letters makes two texts ``threshold`` similar, in whole numbers; null if any is null."""
    return 200 * common >= threshold * (F.length(a) + F.length(b))


def ratio(common: Column, a: Column, b: Column) -> Column:
    """The similarity in percent; two empty texts are alike, null if any is null."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * common / total)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """False only where lengths and letters alone rule the threshold out."""
    la, lb = F.length(a), F.length(b)
    bound = F.least(la, lb) * 200 >= threshold * (la + lb)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    # spaces and other letters are let through
    rest = F.least(F.length(F.translate(a, letters, "")), F.length(F.translate(b, letters, "")))
    shared = rest
    for c in letters:
        shared = shared + F.least(count(a, c), count(b, c))
    return bound & (200 * shared >= threshold * (la + lb))
