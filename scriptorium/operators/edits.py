"""Edit distances of long texts: bits of whole columns at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of a symbol from which its bits are remembered; rarer ones are put together at each use.
FREQUENT = 16


def _places(symbols: Sequence) -> Callable[[object], int]:
    """symbol -> number whose bits are its places."""
    at: dict[object, list[int]] = {}
    for i, s in enumerate(symbols):
        at.setdefault(s, []).append(i)
    known: dict[object, int] = {}

    def bits(symbol: object) -> int:
        places = at.get(symbol)
        if places is None:
            return 0
        if len(places) < FREQUENT:
            return sum(1 << p for p in places)
        if symbol not in known:
            flags = np.zeros(len(symbols), np.uint8)
            flags[places] = 1
            known[symbol] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        return known[symbol]

    return bits


def distance(a: Sequence, b: Sequence) -> int:
    """The least number of symbols to insert, delete or replace that makes b of a.

    A column of the table of distances is held as two numbers, of the places where it rises and
    where it falls by one, and each symbol of b moves both at once (Myers' bit-parallel method,
    with Python's long integers as words). What both begin and end with is left out first.
    """
    n = min(len(a), len(b))
    start = 0
    while start < n and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    bits = _places(b)
    full, high = (1 << len(b)) - 1, 1 << (len(b) - 1)
    rises, falls, score = full, 0, len(b)
    for symbol in a:
        equal = bits(symbol)
        down = equal | falls
        across = (((equal & rises) + rises) ^ rises) | equal
        up, less = falls | (full & ~(across | rises)), rises & across
        if up & high:
            score += 1
        elif less & high:
            score -= 1
        up, less = (up << 1 | 1) & full, less << 1 & full
        rises, falls = less | (full & ~(down | up)), up & down
    return score


@F.pandas_udf(T.LongType())
def char_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype="Int64")


def word_distance(a: Column, b: Column) -> Column:
    """Distance over the words of texts in which single spaces part them."""
    return _word_distance(a, b)
