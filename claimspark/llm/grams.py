"""Near pairs by shared grams: MinHash keys, groups of rows that share a key, an exact test of the pairs in a group.

A row is a set of 64-bit shingle hashes; a key is made of one or more of its minima under multiply-shift hashes. Rows
that share a key are a group; the test alone decides whether two rows link. A group is compared in one task, where a
pair that is joined already, by whatever links, is not tested: only spanning links are reported, and a large group of near
copies costs one test a row. Groups of more than about ``tile`` rows, found by counting the
keys of one row in ``SAMPLE`` (which only decides how a group is dealt out), are split into pairs of chunks.

A row is named by its place: 48 bits of a hash, then 16 bits of its size (65535 for larger ones). Rows that share a
place are told apart by their full key, and all of them are tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import connected_components, drop_staged, stage

_MULT = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}
_LAST = np.uint64((1 << 64) - 1)
SAMPLE = 64
#: Groups up to this size are looked at together; of larger ones so many rows at once against the others.
MIDDLE, HEADS = 128, 64
#: Rows of keys that are looked through at once.
TOGETHER = 1 << 17
ASK, SETTLE = 1, 2
#: Pairs left to ``settle`` that are held at once, with links found by then.
HELD = 1 << 16


class Tester(Protocol):
    """The test of pairs of numbers of rows: ``likely`` rules most out (0), of many pairs and the keys of the groups they are met in; the
    others are to be asked of ``sure`` (``ASK``), which is True, False or, where it would be dear, None, or left to ``settle`` at once
    (``SETTLE``), which decides. ``far`` tells which of many pairs surely don't link, if it can, before they are settled."""

    def likely(self, i: np.ndarray, j: np.ndarray, g: np.ndarray) -> np.ndarray: ...

    def sure(self, i: int, j: int) -> bool | None: ...

    def far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray: ...

    def settle(self, i: np.ndarray, j: np.ndarray) -> np.ndarray: ...




def _powers(base: int, n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, kept for the worker."""
    if len(_POWERS.get(base, ())) < n:
        row = np.full(max(n, 1 << 19), base, dtype=np.uint64)
        row[0] = 1
        _POWERS[base] = np.multiply.accumulate(row)
    return _POWERS[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


_FACTORS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT)) | np.uint64(1)
_SHIFTS = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(_MULT))


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row number, bytes) of each word of a buffer of rows that end in a newline; words are cut at spaces."""
    a = np.frombuffer(buffer, dtype=np.uint8)
    gap = (a == 32) | (a == 10)
    edge = np.diff(np.concatenate([[True], gap, [True]]).view(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    # a word's hash: its bytes as digits, last byte lowest, from running sums scaled back by the inverse powers
    run = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers(pow(_MULT, -1, 1 << 64), len(a)), out=run[1:])
    h = mix((run[end] - run[start]) * _powers(_MULT, len(a))[end - 1]) if len(end) else np.zeros(0, dtype=np.uint64)
    return h, np.cumsum(a == 10)[start], end - start


def shingles_of(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many a row) of the n-word shingles, repeats included; ``counts`` words in each row, one at least. A row of fewer
    words is one shingle."""
    first = np.cumsum(counts) - counts
    left = np.repeat(first + counts, counts) - np.arange(len(h))
    g = h * _FACTORS[255]
    for q in range(1, n):
        g[:-q] += np.where(left[:-q] > q, h[q:] * _FACTORS[255 - q], np.uint64(0))
    made = np.maximum(counts - n + 1, 1)
    return mix(g[np.repeat(counts, counts) - left < np.repeat(made, counts)]), made


def minima(g: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """[row, size]: the least hash of each row under ``size`` multiply-shift hashes; ``counts`` hashes in each row, one at least."""
    first = np.cumsum(counts) - counts
    return np.stack([np.minimum.reduceat((g + _SHIFTS[s]) * _FACTORS[s], first) for s in range(size)], axis=1)


def band_keys(least: np.ndarray, rows: int, salt: int = 0) -> np.ndarray:
    """[row, band]: one key for each ``rows`` minima."""
    bands = least.shape[1] // rows
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(salt * 1000 + 1), (len(least), bands))
    for i in range(rows):
        key = mix(key * np.uint64(_MULT) + least[:, i : bands * rows : rows])
    return key.view(np.int64)


def place(hash_: Column, size: Column) -> Column:
    return hash_.bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(F.least(size, F.lit(0xFFFF)).cast("long"))


def whole_groups(batches: Iterator[pd.DataFrame], key: str = "g", least: int = 0) -> Iterator[pd.DataFrame]:
    """The rows again, cut only between groups, ``least`` rows or more at a time: rows come sorted by ``key``, and a group may go on in the
    next batch."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        if not len(b):
            continue
        k = b[key].to_numpy()
        if held and (size + len(b) < least or held[-1][key].iloc[-1] == k[0] == k[-1]):
            held.append(b)
            size += len(b)
            continue
        cut = int(np.searchsorted(k, k[-1]))
        yield pd.concat([*held, b[:cut]])
        held, size = [b[cut:]], len(b) - cut
    if held:
        yield pd.concat(held)


def several(wholes: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Tables of whole groups, put together up to ``most`` characters of bodies; 0: as they come."""
    held, size = [], 0
    for w in wholes:
        more = int(w["size"].sum())
        if held and size + more > most:
            yield pd.concat(held)
            held, size = [], 0
        held.append(w)
        size += more
    if held:
        yield pd.concat(held)


def bounds(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of equal rows."""
    change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    ends = np.append(np.nonzero(change)[0] + 1, len(columns[0])) if len(columns[0]) else np.zeros(0, dtype=np.int64)
    return np.append(0, ends)[:-1], ends


def shared(rows: pd.DataFrame) -> pd.DataFrame:
    """(g, fp) of the places that have another in their group."""
    return within_reach(rows["g"].to_numpy(), rows["fp"].to_numpy(), 0.0)


def within_reach(g: np.ndarray, fp: np.ndarray, similarity: float) -> pd.DataFrame:
    """(g, fp) of the places that have another in their group whose size allows the similarity (0: any)."""
    size = fp & 0xFFFF if similarity else fp * 0
    order = np.lexsort((fp, size, g))
    g, fp, size = g[order], fp[order], size[order]
    begin, _ = bounds(g, fp)
    g, fp, size = g[begin], fp[begin], size[begin]
    # sizes only grow in a group: the next place is the nearest above; one of 65535 stands for all larger ones
    meets = (g[1:] == g[:-1]) & ((size[:-1] >= similarity * size[1:] - 1e-9) | (size[1:] == 0xFFFF)) if len(g) else np.zeros(0, dtype=bool)
    keep = np.append(meets, False) | np.append(False, meets) if len(g) else np.zeros(0, dtype=bool)
    return pd.DataFrame({"g": g[keep], "fp": fp[keep]})


def candidate_groups(rows: DataFrame, keys: Callable[[DataFrame], DataFrame], tile: int = 8192, within: Callable[[pd.DataFrame], pd.DataFrame] = shared) -> DataFrame:
    """(g, fp): the groups of places to compare. ``keys`` gives (g, fp, ...) of a table of rows, ``within`` those of whole groups, sorted by
    (g, fp), that are worth comparing."""
    part = rows.where(F.pmod(F.shiftrightunsigned("fp", 16), F.lit(SAMPLE)) == 0)
    hot = keys(part).select("g", "fp").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * (2 * SAMPLE) > tile)
    hot = stage(hot.select(F.col("g").alias("hot"), F.ceil(F.col("n") * (2 * SAMPLE) / tile).cast("int").alias("chunks")), "hot-keys")
    near = keys(rows)
    if not hot.isEmpty():
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        other = F.explode(F.when(F.col("chunks") > 2, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.lit(None).cast("int"))))
        dealt = near.join(hot, F.col("g") == F.col("hot"), "left").withColumn("own", own).withColumn("other", other)
        pair = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).bitwiseAND(F.lit(~3)).bitwiseOR(F.col("g").bitwiseAND(F.lit(3)))  # the two low bits say whose key it is
        near = dealt.withColumn("g", F.when(F.col("other").isNull(), F.col("g")).otherwise(pair)).select(*near.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches, least=TOGETHER):
            yield within(whole)

    return near.repartition("g").sortWithinPartitions("g", "fp").mapInPandas(run, "g long, fp long")


class Joined:
    """Which of n numbers are joined."""

    def __init__(self, n: int) -> None:
        self.of, self.links = list(range(n)), 0

    def root(self, i: int) -> int:
        of = self.of
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.of[max(i, j)] = min(i, j)
        self.links += i != j


def link_groups(g: np.ndarray, number: np.ndarray, sizes: np.ndarray, n: int, similarity: float, tester: Tester) -> np.ndarray:
    """The least number that each of n is joined to by links in runs of ``g``; rows come sorted by (g, size). All pairs of a run that
    sizes allow are looked at, and those that are not joined yet are tested."""
    begin, end = bounds(g)
    allowed = lambda i, j: sizes[j] - sizes[i] <= (1 - similarity) * sizes[j] + 1e-9
    joined, unsure, dear, left, held = Joined(n), [], [], [], 0

    def apart(pairs: np.ndarray) -> np.ndarray:
        root = np.fromiter((joined.root(k) for k in range(n)), dtype=np.int64, count=n)
        return pairs[root[pairs // n] != root[pairs % n]]

    def decide(last: bool = False) -> None:
        nonlocal held
        i, j = (np.concatenate([np.array([p[k] for p in unsure], dtype=np.int64), *(d[k] for d in dear)]) for k in (0, 1))
        unsure.clear(), dear.clear()
        held, pairs = 0, apart(np.unique(np.minimum(i, j) * n + np.maximum(i, j)))
        if len(pairs):
            left.append(pairs[~tester.far(pairs // n, pairs % n)])
        if last or sum(map(len, left)) > HELD // 4:  # few at a time would each be dear
            pairs = apart(np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *left])))
            left.clear()
            if len(pairs):
                hit = pairs[tester.settle(pairs // n, pairs % n)]
                for p, q in zip((hit // n).tolist(), (hit % n).tolist(), strict=True):
                    joined.join(p, q)

    def look(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal held
        for at in range(0, len(x), 50_000):
            i, j = number[x[at : at + 50_000]], number[y[at : at + 50_000]]
            kind = tester.likely(i, j, g[x[at : at + 50_000]])
            hit, later = kind == ASK, kind == SETTLE
            if later.any():
                dear.append((i[later], j[later]))
                held += int(later.sum())
            for p, q in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
                if joined.root(p) != joined.root(q):
                    sure = tester.sure(p, q)
                    if sure:
                        joined.join(p, q)
                    elif sure is None:
                        unsure.append((p, q))
            if held + len(unsure) > HELD:
                decide()

    few = end - begin <= MIDDLE
    here, last = np.nonzero(np.repeat(few, end - begin))[0], np.repeat(end, end - begin)
    for step in range(1, MIDDLE):
        here = here[here + step < last[here]]
        here = here[allowed(here, here + step)]  # sizes only grow in a group: no further partner either
        if not len(here):
            break
        look(here, here + step)
    for s, e in zip(begin[~few].tolist(), end[~few].tolist(), strict=True):
        rest, many = np.arange(s, e), 1
        while len(rest) > 1:
            links = joined.links
            if many > 1:  # none was joined of late: more rows at once, each against all after it
                x = np.repeat(np.arange(min(many, len(rest) - 1)), len(rest) - 1 - np.arange(min(many, len(rest) - 1)))
                y = np.arange(len(x)) - np.searchsorted(x, x) + x + 1
                x, y, rest = rest[x], rest[y], rest[many:]
                near = allowed(x, y)
                look(x[near], y[near])
            else:  # what is joined to a row is looked at from there, against what is not joined to it
                todo, rest = [int(rest[0])], rest[1:]
                while todo and len(rest):
                    x = todo.pop()
                    low, high = np.minimum(rest, x), np.maximum(rest, x)
                    at = np.nonzero(allowed(low, high))[0]
                    look(low[at], high[at])
                    root = joined.root(int(number[x]))
                    got = np.zeros(len(rest), dtype=bool)
                    got[at] = [joined.root(i) == root for i in number[rest[at]].tolist()]
                    todo += rest[got].tolist()
                    rest = rest[~got]
            many = min(2 * many, HEADS) if links == joined.links else 1
    if unsure or dear or left:
        decide(True)
    return np.fromiter((joined.root(i) for i in range(n)), dtype=np.int64, count=n)


def sieve(rows: DataFrame, bits: int = 26, part: int = 16) -> Callable[[np.ndarray], np.ndarray]:
    """A test that passes every place of ``rows`` and some others: a map of 2^``bits`` bits, 8 MB whatever the table holds, made in
    pieces by the tasks. Fuller maps let more rows pass, and all of them are joined after it."""
    slot = F.shiftrightunsigned("fp", 64 - bits)

    def piece(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(1 << part, dtype=bool)
        seen[df["low"].to_numpy()] = True
        return pd.DataFrame({"high": [key[0]], "map": [np.packbits(seen).tobytes()]})

    slots = rows.select(F.shiftrightunsigned(slot, part).cast("int").alias("high"), slot.bitwiseAND(F.lit((1 << part) - 1)).cast("int").alias("low")).distinct()
    held = np.zeros((1 << (bits - part), (1 << part) // 8), dtype=np.uint8)
    for r in slots.groupBy("high").applyInPandas(piece, "high int, map binary").toLocalIterator():  # 2^(bits - part) rows at most
        held[r.high] = np.frombuffer(r.map, dtype=np.uint8)
    flat = rows.sparkSession.sparkContext.broadcast(held.reshape(-1))

    def test(fp: np.ndarray) -> np.ndarray:
        at = fp.view(np.uint64) >> np.uint64(64 - bits)
        return (flat.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1

    return test


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number in reach of each of n over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        was = root.copy()
        np.minimum.at(root, a, was[b])
        np.minimum.at(root, b, was[a])
        root = root[root]
        if (was == root).all():
            break
    return root


def near_groups(groups: DataFrame, bodies: DataFrame, tester: Callable[[list], Tester], similarity: float, together: int = 0, few: bool = False) -> DataFrame:
    """(node, root) over ``key`` of what links in the groups (g, fp).

    bodies: (fp, key, size, body) of the rows; ``few``: no key stands in many of them. tester: from a list of bodies to the test of pairs of
    their numbers. Groups that come one after another are compared at once up to ``together`` characters of bodies.
    """
    groups = stage(groups, "groups")
    likely = sieve(groups)

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # most rows are in no group and need not move; a row that many share is a few
            yield b[likely(b["fp"].to_numpy())].drop_duplicates("key")

    @F.pandas_udf("boolean")
    def there(fp: pd.Series) -> pd.Series:
        return pd.Series(likely(fp.to_numpy()))

    met = bodies.where(there("fp")) if few else bodies.mapInPandas(once, bodies.schema)
    wanted = met.join(groups, "fp").select("g", "key", "size", "body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in several(whole_groups(batches), together):
            rows = whole.drop_duplicates(["g", "key"]).sort_values(["g", "size", "key"], ignore_index=True)
            if len(rows) > 1:
                number, kinds = pd.factorize(rows["key"])
                body = rows["body"].to_numpy()
                first = np.zeros(len(kinds), dtype=np.int64)
                first[number[::-1]] = np.arange(len(rows))[::-1]
                root = link_groups(rows["g"].to_numpy(), number, rows["size"].to_numpy(dtype=np.int64), len(kinds), similarity, tester([body[i] for i in first]))
                joined = np.nonzero(root != np.arange(len(kinds)))[0]
                if len(joined):
                    yield pd.DataFrame({"a": kinds[root[joined]], "b": kinds[joined]})

    links = wanted.repartition("g").sortWithinPartitions("g").mapInPandas(run, "a binary, b binary")
    found = connected_components(links)
    drop_staged(groups)
    return found
