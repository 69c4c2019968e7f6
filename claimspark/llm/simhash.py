"""SimHash near-dedup by anchor-point covering.

Fingerprints (64 bits) link at 4 or fewer differing bits. Bits 0-30 and 31-61 are two blocks; of 4 differing bits one
block has at most 2, so such a pair has a block midpoint within 1 bit of both. The anchors of a block are the
codewords of the perfect [31,26] Hamming code, covering radius 1: the midpoint's anchor is within 1 + 1 = 2 bits of
both. Each fingerprint is replicated to every anchor within covering radius plus that threshold (16 of 2^26 at most),
the whole fingerprints are compared per anchor, and links become connected components.

Equal fingerprints are one entry. An anchor with more than ``tile`` entries is dealt out over pairs of chunks, so no
task holds more than two chunks; a task reports the spanning links of what it compares, never all pairs.

Null text counts as empty; texts without words have fingerprint zero; ties and repeated rows share a component; the
component of a null id is named by the smallest non-null id there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import connected_components, stage, table

#: Groups up to this size are compared all at once, unless they have more links than members.
SMALL = 64
MASK31 = np.uint64((1 << 31) - 1)


def shingle_hashes(words: list[bytes], n: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the space-joined shingles, in pieces of bounded size."""
    from xxhash import xxh64_intdigest

    if not words:
        return
    if len(words) <= n:
        yield np.array([xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
        return
    step = 200_000
    for at in range(0, len(words) - n + 1, step):
        part = words[at : at + step + n - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        yield np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[: len(part) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(part) - n + 1)


#: The bits of a byte, each in a byte of its own: sums of up to 255 of these keep eight counts in one integer.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[run, 64]: how many hashes of each run have each bit; runs begin at ``starts``, the first at 0."""
    ends = np.append(starts[1:], len(h))
    pieces = -(-(ends - starts) // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    lanes = np.stack([np.add.reduceat(_SPREAD[h.view(np.uint8)[i::8]], cuts) for i in range(8)], axis=1)
    counts = lanes.view(np.uint8).reshape(-1, 64)
    return np.add.reduceat(counts, first, axis=0, dtype=np.int64) if len(cuts) > len(starts) else counts.astype(np.int64)


def fingerprint(text: str | None, n: int = 4) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes((text or "").encode(errors="replace").lower().split(), n):
        total += len(h)
        counts += bit_counts(h, np.zeros(1, dtype=np.int64))[0]
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4) -> DataFrame:
    """(id, fp long) of each row; one pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, n) for t in b["t"]), dtype=np.uint64, count=len(b))
            yield pd.DataFrame({"id": b["i"], "fp": fps.view(np.int64)})

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, fp long")


def _offsets() -> np.ndarray:
    """[syndrome, 16]: the error patterns of weight 2 or less with that syndrome; bit i of a block has column i + 1."""
    table_ = np.zeros((32, 16), dtype=np.uint64)
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i ^ s and i < i ^ s]
        table_[s] = [1 << (s - 1), *pairs]
    return table_


OFFSETS = _offsets()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, anchor key) of every anchor near each fingerprint; key: block number, then the codeword."""
    rows, keys = [], []
    for block in (0, 1):
        x = (fps >> np.uint64(31 * block)) & MASK31
        syndrome = np.zeros(len(x), dtype=np.int64)
        for bit in range(31):
            syndrome ^= ((x >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) * (bit + 1)
        near = x[:, None] ^ OFFSETS[syndrome]
        use = np.ones(near.shape, dtype=bool)
        use[syndrome == 0, 1:] = False
        rows.append(np.nonzero(use)[0])
        keys.append(near[use] | np.uint64(block << 31))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def spanning_links(fps: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(smallest of the component, member) of the link graph over distinct fingerprints: no pair is left out, but
    members already reached are not compared again."""
    left = np.sort(fps)
    a, b = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                got = left[near]
                a.append(np.full(len(got), root))
                b.append(got)
                todo.extend(got)
                left = left[~near]
    z = np.array([], dtype=fps.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (z, z)


def links(fps: DataFrame, most: int = 4, tile: int = 8192) -> DataFrame:
    """(a, b): spanning links among the distinct long column ``fp`` at ``most`` (4 or fewer) differing bits."""
    if most > 4:
        raise ValueError(f"the anchors cover 4 differing bits, not {most}")

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b["fp"].to_numpy(dtype=np.int64)
            r, k = anchors(x.view(np.uint64))
            yield pd.DataFrame({"k": k, "fp": x[r]})

    near = stage(fps.select("fp").mapInPandas(replicate, "k long, fp long"), "anchors")
    return compare_tiles(spread(near, tile), most)


def spread(near: DataFrame, tile: int) -> DataFrame:
    """(k, fp, t) of the rows of (k, fp) whose key others share too; a key with more than ``tile`` rows is dealt out over
    pairs of chunks, each a t of its own."""
    many = near.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", F.ceil(F.col("n") / (tile // 2)).cast("int").alias("g"))
    met = near.join(many, "k")
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    other = F.explode(F.when(F.col("g") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("g") - 1)))
    met = met.select("k", "fp", "g", own.alias("c"), other.alias("o"))
    return met.select(F.xxhash64("k").alias("k") if "struct" in near.schema["k"].dataType.simpleString() else "k", "fp", F.when(F.col("g") <= 2, 0).otherwise(F.least("c", "o") * 65536 + F.greatest("c", "o")).alias("t"))


def whole_tiles(batches: Iterator[pd.DataFrame], *key: str) -> Iterator[pd.DataFrame]:
    """The rows again, cut only between tiles: rows come sorted by ``key``, and a tile may go on in the next batch."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = np.logical_and.reduce([(b[k] == b[k].iloc[-1]).to_numpy() for k in key])
        if held and all(held[-1][k].iloc[-1] == b[k].iloc[0] for k in key) and last.all():
            held.append(b)
            continue
        yield pd.concat([*held, b[~last]])
        held = [b[last]]
    if held:
        yield pd.concat(held)


def compare_tiles(tiled: DataFrame, most: int) -> DataFrame:
    """(a, b): spanning links inside each (k, t), whole tiles at a time from rows sorted by tile."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_tiles(batches, "k", "t"):
            yield from _links_of(rows, most)

    return tiled.repartition("k", "t").sortWithinPartitions("k", "t").mapInPandas(compare, "a long, b long")


def _links_of(rows: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    if not len(rows):
        return
    k, t, x = (rows[c].to_numpy() for c in ("k", "t", "fp"))
    x = x.view(np.uint64)
    ends = np.append(np.nonzero((k[1:] != k[:-1]) | (t[1:] != t[:-1]))[0] + 1, len(k))
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    # small groups: all rows against those 1, 2, ... places on, as far as the key lasts
    group = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(k))
    near_a, near_b = [], []
    rows_here = np.nonzero((sizes <= SMALL)[group])[0]
    for step in range(1, SMALL):
        rows_here = rows_here[left[rows_here] > step]
        if not len(rows_here):
            break
        hit = rows_here[np.bitwise_count(x[rows_here] ^ x[rows_here + step]) <= most]
        near_a.append(hit)
        near_b.append(hit + step)
    hit_a, hit_b = (np.concatenate(n) if n else np.zeros(0, dtype=np.int64) for n in (near_a, near_b))
    dense = (np.bincount(group[hit_a], minlength=len(sizes)) > sizes) | (sizes > SMALL)
    few = ~dense[group[hit_a]]
    found = [(x[hit_a[few]], x[hit_b[few]])]
    found += [spanning_links(x[s:e], most) for s, e in zip(starts[dense].tolist(), ends[dense].tolist(), strict=True)]
    a, b = (np.concatenate([f[i] for f in found]).astype(np.uint64).view(np.int64) for i in (0, 1))
    if len(a):
        pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        yield pairs.drop_duplicates()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, most: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of each row; component_id: the smallest id reachable over links, itself included."""
    rows = stage(fingerprints(docs, id_col, text_col, n), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("low"))
    parts = connected_components(links(classes, most))
    named = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "components")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
