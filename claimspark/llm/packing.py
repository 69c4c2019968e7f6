"""Best-fit packing in several dimensions: residual tokens, documents and attention cost of a sequence.

Pieces go largest first into the open sequence that is best by weighted dot product or residual norm under every
capacity; attention cost of a piece is its length squared. Texts longer than a sequence are cut into full pieces and
a shorter last one; nothing else is cut. Pieces are dealt evenly over groups by hash, each packed by itself; a group
is large enough that what its last sequences leave open is a small part.

Null text counts as empty (the end id alone); null ids are packed like others; repeated rows are packed each; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import TEXTS, batches_of, fresh, parts_for, stage, table
from claimspark.llm.tokens import default_tokenizer, encoder


def cut_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece; one pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for b in batches:
            rows = []
            for i, t in zip(b["i"], b["t"], strict=True):
                raw = ids_of(t) + end
                for piece, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at : at + 4 * length]
                    rows.append((None if pd.isna(i) else i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


#: Of tokens, documents and attention cost in the residual norm or dot product; a bin open in tokens alone is a waste of sequence.
WEIGHTS = (1.0, 0.05, 0.05)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece by decreasing length; capacity: tokens, documents, attention cost of a bin."""
    need = np.column_stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2])
    if (need > capacity).any():
        raise ValueError("a piece exceeds the capacity of a sequence")
    w = np.asarray(weights) / np.asarray(capacity) ** 2
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room = np.zeros((len(lengths), 3))
    opened, made = np.zeros(0, dtype=np.int64), 0
    least = need.min(axis=0) if len(need) else None
    for at in np.argsort(-lengths, kind="stable"):
        item = need[at]
        if item[0] < capacity[0]:
            after = room[opened] - item
            fits = (after >= 0).all(axis=1)
            cost = np.where(fits, (after**2) @ w if rule == "norm" else -(room[opened] * item) @ w, np.inf)
            best = int(cost.argmin()) if len(cost) else -1
        else:
            best = -1
        if best >= 0 and fits[best]:
            b = opened[best]
        else:
            b, made = made, made + 1
            room[b] = capacity
            best = len(opened)
            opened = np.append(opened, b)
        offsets[at], bins[at] = capacity[0] - room[b, 0], b
        room[b] -= item
        if (room[b] < least).any():  # nothing goes in any more
            opened = np.delete(opened, best)
    return bins, offsets


def pack(pieces: DataFrame, length: int = 2048, most_documents: int = 2048, most_attention: float | None = None, group_pieces: int = 8192, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Adds sequence_id and offset to every row of ``pieces``, a table with the columns id, piece, length and ids_crc32 and any others.

    most_documents, most_attention: capacities of a sequence beside its tokens. The defaults are the most that a sequence of ``length``
    tokens can hold of either, for the fewest sequences; smaller ones bind.
    """
    n, (group,) = parts_for(pieces, group_pieces), fresh(pieces, "g")
    capacity = (float(length), float(most_documents), float(most_attention or length**2))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "ids_crc32"], ascending=False, ignore_index=True)
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, weights, rule)
        return rows.assign(sequence_id=rows[group].astype("int64") * (1 << 32) + bins, offset=offsets).drop(columns=group)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    dealt = pieces.withColumn(group, F.pmod(F.xxhash64("id", "piece"), F.lit(n)) if n > 1 else F.lit(0).cast("long"))
    return dealt.groupBy(group).applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **capacities) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of each piece; capacities: those of ``pack``."""
    with batches_of(docs.sparkSession, TEXTS):
        pieces = stage(cut_pieces(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    return pack(pieces, length, **capacities).withColumnRenamed("id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


ORACLE: dict[str, str] = {}
