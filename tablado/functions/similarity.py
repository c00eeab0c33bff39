"""The three measures of string likeness, as Arrow-batched functions: no built-in is equal to them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratcliff_text(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio.  It depends on the order of its arguments: the later row comes first."""
    return SequenceMatcher(None, a, b).ratio()


def indel_text(a: str, b: str) -> float:
    """Normalised Indel likeness from 0 to 100: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    # Bit-parallel longest common subsequence: one bit a letter of ``a``.
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def _pairwise(f, a: Column, b: Column) -> Column:
    return F.pandas_udf(lambda x, y: pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y, strict=True)], dtype="float64"), "double")(a, b)


def ratcliff(later: Column, earlier: Column) -> Column:
    return _pairwise(ratcliff_text, later, earlier)


def indel(a: Column, b: Column) -> Column:
    return _pairwise(indel_text, a, b)
