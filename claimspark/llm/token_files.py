"""Token-id files of patched frame-of-reference (PFOR) blocks.

A file is a run of segments, each followed by one newline byte. A segment (all little-endian):

    header   "PFR1", partition u32, number u32, documents u32, ids u32, block size u16, blocks u32, bytes of body u64
    table    id of each document i64, 1 where it is null u8, ids of each document u32
    index    where each block starts in the body u32
    body     blocks: minimum u32, width u8, 0 u8, exceptions u16; values minus the minimum, their low ``width`` bits
             packed; then position u16 of each exception, then its bits above ``width`` u32

The width of a block holds the given percentile of its values; the others are exceptions. Spark's text writer puts
the segments into files, so any store and its commit protocol serve, and binaryFile reads them back.

Null text counts as empty (the end id alone); null ids come first; ties and repeated rows each get a place; an empty
table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import stage, staged_path, table
from claimspark.llm.tokens import default_tokenizer, encoder

HEADER = struct.Struct("<4sIIIIHIQ")
FIXED = 8  # bytes of a block before its packed values


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack_blocks(ids: np.ndarray, block: int = 128, percentile: float = 0.9) -> tuple[np.ndarray, bytes]:
    """(start of each block, body); ids unsigned 32-bit; block a multiple of 8."""
    n = -(-len(ids) // block)
    if not n:
        return np.zeros(0, dtype="<u4"), b""
    a = np.concatenate([ids, np.full(n * block - len(ids), ids[-1])]).astype(np.uint32).reshape(n, block)
    low = a.min(axis=1)
    rest = a - low[:, None]
    at = max(0, int(np.ceil(percentile * block)) - 1)
    width = _bit_length(np.partition(rest, at, axis=1)[:, at])
    high = (rest.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    odd_block, odd_at = np.nonzero(high)
    odd = np.bincount(odd_block, minlength=n)
    packed = width * block // 8
    size = FIXED + packed + 6 * odd
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    body = np.zeros(int(size.sum()), dtype=np.uint8)
    head = np.zeros(n, dtype=[("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("odd", "<u2")])
    head["low"], head["width"], head["odd"] = low, width, odd
    body[start[:, None] + np.arange(FIXED)] = head.view(np.uint8).reshape(n, FIXED)
    for w in np.unique(width):
        if w:
            rows = np.nonzero(width == w)[0]
            bits = np.unpackbits(rest[rows].astype("<u4").view(np.uint8).reshape(len(rows), block, 4), axis=2, bitorder="little", count=int(w))
            body[(start[rows] + FIXED)[:, None] + np.arange(w * block // 8)] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
    if len(odd_block):
        rank = np.arange(len(odd_block)) - (np.cumsum(odd) - odd)[odd_block]
        first = start[odd_block] + FIXED + packed[odd_block]
        body[(first + 2 * rank)[:, None] + np.arange(2)] = odd_at.astype("<u2").view(np.uint8).reshape(-1, 2)
        body[(first + 2 * odd[odd_block] + 4 * rank)[:, None] + np.arange(4)] = high[odd_block, odd_at].astype("<u4").view(np.uint8).reshape(-1, 4)
    return start.astype("<u4"), body.tobytes()


def unpack_blocks(start: np.ndarray, body: bytes, n_ids: int, block: int) -> np.ndarray:
    """The ids; any run of blocks can be read alone by its starts."""
    n = len(start)
    raw, start = np.frombuffer(body, dtype=np.uint8), start.astype(np.int64)
    if not n:
        return np.zeros(0, dtype="<u4")
    head = raw[start[:, None] + np.arange(FIXED)].copy().view([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("odd", "<u2")])[:, 0]
    width, odd = head["width"].astype(np.int64), head["odd"].astype(np.int64)
    out = np.zeros((n, block), dtype=np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.nonzero(width == w)[0]
            bits = np.unpackbits(raw[(start[rows] + FIXED)[:, None] + np.arange(w * block // 8)], axis=1, bitorder="little").reshape(len(rows), block, w)
            wide = np.zeros((len(rows), block, 16 if w <= 16 else 32), dtype=np.uint8)
            wide[:, :, :w] = bits
            out[rows] = np.packbits(wide, axis=2, bitorder="little").view("<u2" if w <= 16 else "<u4")[:, :, 0]
    if odd.any():
        of = np.repeat(np.arange(n), odd)
        rank = np.arange(len(of)) - (np.cumsum(odd) - odd)[of]
        first = start[of] + FIXED + width[of] * block // 8
        at = raw[(first + 2 * rank)[:, None] + np.arange(2)].copy().view("<u2")[:, 0]
        high = raw[(first + 2 * odd[of] + 4 * rank)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[of, at] |= (high.astype(np.uint64) << width[of].astype(np.uint64)).astype(np.uint32)
    return (out + head["low"][:, None]).reshape(-1)[:n_ids]


def segment(part: int, number: int, ids_of: list[int | None], sizes: list[int], ids: bytes, block: int = 128, percentile: float = 0.9) -> bytes:
    a = np.frombuffer(ids, dtype="<u4")
    start, body = pack_blocks(a, block, percentile)
    named = np.array([0 if i is None else i for i in ids_of], dtype="<i8").tobytes() + bytes(i is None for i in ids_of)
    return HEADER.pack(b"PFR1", part, number, len(ids_of), len(a), block, len(start), len(body)) + named + np.array(sizes, dtype="<u4").tobytes() + start.tobytes() + body


def read_segments(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(partition, number, document ids, sizes, ids) of each segment of a file."""
    at = 0
    while at < len(content):
        magic, part, number, docs, n_ids, block, blocks, size = HEADER.unpack_from(content, at)
        if magic != b"PFR1":
            raise ValueError("not a token file")
        at += HEADER.size
        named = np.frombuffer(content, "<i8", docs, at).tolist()
        null = content[at + 8 * docs : at + 9 * docs]
        at += 9 * docs
        sizes = np.frombuffer(content, "<u4", docs, at)
        start = np.frombuffer(content, "<u4", blocks, at + 4 * docs)
        at += 4 * docs + 4 * blocks
        yield part, number, [None if z else i for i, z in zip(named, null, strict=True)], sizes, unpack_blocks(start, content[at : at + size], n_ids, block)
        at += size + 1


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block: int = 128, percentile: float = 0.9, segment_ids: int = 1 << 20) -> None:
    """Encode every text, append ``end_id``, and write the files at ``path`` in ascending order of the id."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    rows = rows.repartitionByRange("i", F.xxhash64("t")).sortWithinPartitions("i", F.xxhash64("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, end = encoder(tokenizer), struct.pack("<I", end_id)
        part, number = TaskContext.get().partitionId(), 0
        names, sizes, held, n = [], [], [], 0
        for b in batches:
            for i, t in zip(b["i"], b["t"], strict=True):
                got = ids_of(t) + end
                names.append(None if pd.isna(i) else int(i))
                sizes.append(len(got) // 4)
                held.append(got)
                n += sizes[-1]
                if n >= segment_ids:
                    yield pd.DataFrame({"s": [segment(part, number, names, sizes, b"".join(held), block, percentile)]})
                    number, names, sizes, held, n = number + 1, [], [], [], 0
        if names:
            yield pd.DataFrame({"s": [segment(part, number, names, sizes, b"".join(held), block, percentile)]})

    with_batches = rows.mapInPandas(run, "s binary")
    with_batches.select(F.col("s").cast("string").alias("value")).write.option("maxRecordsPerFile", 16).text(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in the files at ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                for part, number, names, sizes, ids in read_segments(content):
                    ends = np.cumsum(sizes.astype(np.int64))
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                    yield pd.DataFrame({"part": part, "number": number, "i": pd.array(names, dtype="Int64"), "local": ends - sizes, "n_tokens": sizes.astype(np.int64), "ids_crc32": np.array(crc, dtype=np.int64)})

    rows = stage(files.select("content").mapInPandas(run, "part int, number int, i long, local long, n_tokens long, ids_crc32 long"), "token-table")
    sums = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))  # one row for each segment of a million ids
    base = sums.select("part", "number", (F.sum("n").over(Window.orderBy("part", "number")) - F.col("n")).alias("base"))
    return rows.join(base, ["part", "number"]).select(F.col("i").alias(id_col), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return read_token_files(spark, path)


ORACLE: dict[str, str] = {}
