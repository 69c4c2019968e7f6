"""Near copies of documents: word shingles of five, Jaccard similarity 0.8 or more, one document of a group.

Candidates come from two searches, and the Jaccard similarity of the full shingle sets alone decides. First, as in ``simhash``:
SimHashes of the shingles, anchors, links at 4 or fewer differing bits, components. Few pairs at 0.8 are as near as 4 bits of 64, so
second: keys of three minima of the hashes of the shingles (``BANDS`` keys: of pairs at 0.8 about one in 100,000 shares none). A document is its id and its text, so null
and repeated ids keep all their different texts; rows equal in both are one document. Texts without words are equal to
each other. An empty table stays empty; other columns go through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import connected_components, drop_staged, fresh, stage
from claimspark.llm.grams import band_keys, candidate_groups, minima, near_groups, shingles_of, word_hashes
from claimspark.llm.simhash import fingerprints, links

BANDS, BAND_ROWS = 16, 3
_SPACES = bytes(32 if 9 <= i <= 13 else i for i in range(256))


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-word shingles, how many of each text); a text without words has one, of a word that no text has."""
    rows = [t.encode(errors="replace").lower().translate(_SPACES) for t in texts]
    h, of, _ = word_hashes(b"".join((r if r.strip(b" ") else b"\x0b") + b"\n" for r in rows))
    return shingles_of(h, np.bincount(of, minlength=len(rows)), n)


def document_keys(docs: DataFrame, n: int) -> DataFrame:
    """(g, fp): the keys of each document (fp, t); one pass, texts some at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cuts = np.nonzero(np.diff(np.cumsum(b["t"].str.len().to_numpy(dtype=np.int64)) >> 18))[0] + 1
            for s, e in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if e > s:
                    keys = band_keys(minima(*shingle_sets(list(b["t"][s:e]), n), BANDS * BAND_ROWS), BAND_ROWS)
                    yield pd.DataFrame({"g": keys.reshape(-1), "fp": np.repeat(b["fp"][s:e].to_numpy(dtype=np.int64), BANDS)})

    return docs.select("fp", "t").mapInPandas(run, "g long, fp long")


def simhash_keys(docs: DataFrame, n: int, most: int = 4) -> DataFrame:
    """(g, fp): the component of each document (fp, t) whose SimHash is linked to another's or equal to it."""
    sims = stage(fingerprints(docs, "fp", "t", n).select(F.col("id").alias("at"), "fp"), "near-simhashes")
    parts = connected_components(links(sims.select("fp").distinct(), most))
    named = sims.join(parts, F.col("fp") == F.col("node"), "left").select(F.xxhash64(F.coalesce("root", "fp"), F.lit(most)).alias("g"), F.col("at").alias("fp"))
    named = stage(named, "near-components")
    drop_staged(sims)
    many = named.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    return named.join(many, "g", "left_semi")


class JaccardTester:
    """Jaccard similarity of the shingle sets of texts."""

    def __init__(self, texts: list[str], n: int, similarity: float) -> None:
        self.least, self.sets = similarity - 1e-9, []
        for at in range(0, len(texts), 64):
            g, made = shingle_sets(texts[at : at + 64], n)
            self.sets += [np.unique(x) for x in np.split(g, np.cumsum(made)[:-1])]
        self.size = np.fromiter(map(len, self.sets), dtype=np.int64, count=len(self.sets))

    def likely(self, i: np.ndarray, j: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.minimum(self.size[i], self.size[j]) >= self.least * np.maximum(self.size[i], self.size[j])

    def sure(self, i: int, j: int) -> bool:
        a, b = sorted((self.sets[i], self.sets[j]), key=len)
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return both >= self.least * (len(a) + len(b) - both)

    def far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.zeros(len(i), dtype=bool)

    def settle(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.sure, i.tolist(), j.tolist()), dtype=bool, count=len(i))


def _key(id_col: str, text_col: str) -> Column:
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return F.unhex(F.sha2(F.concat(name, F.lit("\0"), F.coalesce(F.col(text_col), F.lit(""))), 256))


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, tile: int = 8192) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of each group linked at ``similarity`` the one with the
    smallest id, null ids last."""
    rows = docs.select(F.col(id_col).alias("id"), _key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("fp", F.xxhash64("key"))
    near = stage(simhash_keys(rows, n), "near-bits")
    groups = candidate_groups(rows, lambda r: document_keys(r, n).unionByName(near.join(r.select("fp"), "fp", "left_semi").select("g", "fp")), tile)
    # the number of distinct shingles isn't known before the test, which looks at it first
    groups = near_groups(groups, rows.select("fp", "key", F.lit(1).alias("size"), F.col("t").alias("body")), lambda texts: JaccardTester(texts, n, similarity), similarity)
    ids = stage(rows.select("key", "id"), "document-keys")
    members = ids.distinct().join(groups, F.col("key") == F.col("node")).select("root", "key", "id")
    stay = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "key")).alias("stay"))
    key = fresh(docs, "key")[0]
    gone = members.join(stay, "root").where(F.col("key") != F.col("stay.key")).select(F.col("key").alias(key))
    left = docs.withColumn(key, _key(id_col, text_col)).join(gone, key, "left_anti")
    if not ids.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        left = left.dropDuplicates([key])
    return left.select(*docs.columns)
