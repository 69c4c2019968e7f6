"""How alike two names are, whatever the order of their words and whichever words one has more.

The similarity of two strings is one less the share of characters that have to be taken out or put in; the longest common
subsequence behind it is found bit by bit for all of the shorter string at once.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; time in proportion to the longer string, for shorter ones of a machine word or so."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    free = whole  # positions of a that the subsequence doesn't end a step at
    for c in b:
        if here := places.get(c):
            used = free & here
            free = ((free + used) | (free - used)) & whole
    return len(a) - free.bit_count()


def indel_similarity(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


@lru_cache(maxsize=1 << 16)
def token_set_ratio_of(a: str, b: str) -> float:
    """0 to 100: the best similarity among the words that both have, and these with the other words of either side."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (only_x and only_y):
        return 100.0
    if not both:
        return indel_similarity(only_x, only_y)
    # what both begin with is common to them, so only the rest is compared
    n, m = len(both) + 1 + len(only_x), len(both) + 1 + len(only_y)
    shared = len(both) + 1 + common_subsequence(only_x, only_y)
    return max(200.0 * shared / (n + m), 200.0 * len(both) / (len(both) + n), 200.0 * len(both) / (len(both) + m))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Arrow batches; null where either side is null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else token_set_ratio_of(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def name_on_page(name: Column, text: Column, floor: float = 60, head: int = 4000) -> Column:
    """Whether a page may be that of the name: judged by its first ``head`` characters; an empty name fits any page."""
    name, top = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, head))
    return (name == "") | (token_set_ratio(name, top) >= floor)
