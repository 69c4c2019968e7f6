"""Toxicity by cumulative-link ordinal regression: P(grade <= k) = sigmoid(cut_k - w.x), one w for all cuts.

Features are the words present in a document (A-Z lower-cased, ASCII punctuation as space). The model is fitted on a
bounded sample of labelled rows (``max_train_docs``, by smallest hash of the id); every document is scored whole, in
one pass. Its output is the probability of each grade and the expected severity, sum of k * P(k).

Labels are 0 or 1. Grades 1..3 of toxic rows are the thirds of the score that a model of two grades gives them which was
fitted on the other half of the sample, so no row grades itself. Words that fewer than about one word in 100,000 would
match by chance (``min_g2``) are the features, ``n_features`` at most: other words carry no weight.

Tables without rows give tables without rows; columns but id and text are not read by the scores and go through
``drop_toxic`` untouched. Null or empty text has no features and gets the intercepts alone; null ids are scored like others; labels that are
null are not fitted on; repeated rows are scored alike; without both kinds of label every severity is 0.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import table

_SPACED = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode(errors="replace").lower().translate(_SPACED).split())


@dataclass
class OrdinalModel:
    """weights by word, shared by all cuts; cuts ascending."""

    weights: dict[bytes, float] = field(default_factory=dict)
    cuts: tuple[float, ...] = ()

    def grades(self, found: set[bytes]) -> list[float]:
        """P(0), ..., P(K) of a document with these words."""
        score = sum(self.weights[w] for w in self.weights.keys() & found)
        upto = [1 / (1 + np.exp(min(500.0, score - c))) for c in self.cuts] + [1.0]
        return [b - a for a, b in zip([0.0, *upto[:-1]], upto, strict=True)]


def fit_ordinal(rows: list, grade: np.ndarray, n_features: int, n_grades: int, l2: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(w, cuts) of the cumulative-link model by Adam over all rows; rows: feature numbers of each."""
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows])
    k = n_grades - 1
    share = np.array([(grade <= g).mean() for g in range(k)]).clip(1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])  # cuts as a first and log gaps, so they stay in order
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        cuts = p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(r, weights=w[c], minlength=len(grade))
        up = np.where(grade < k, sig(cuts[np.minimum(grade, k - 1)] - s), 1.0)
        low = np.where(grade > 0, sig(cuts[np.maximum(grade - 1, 0)] - s), 0.0)
        like = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / like, low * (1 - low) / like  # of log-likelihood by the upper and lower cut
        g_w = np.bincount(c, weights=(d_up - d_low)[r], minlength=n_features) / len(grade) + l2 * w
        g_cut = np.array([d_low[grade == g + 1].sum() - d_up[grade == g].sum() for g in range(k)]) / len(grade)
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])


def severity_grades(rows: list, toxic: np.ndarray, n_features: int) -> np.ndarray:
    """0 of clean rows; of toxic ones the third (1 to 3) in which the score falls that a two-grade model of the other half gives."""
    score = np.zeros(len(rows))
    for half in (0, 1):
        own = np.arange(len(rows)) % 2 == half
        w, _ = fit_ordinal([rows[i] for i in np.nonzero(~own)[0]], toxic[~own], n_features, 2, steps=150)
        score[own] = [w[rows[i]].sum() for i in np.nonzero(own)[0]]
    low, high = np.quantile(score[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 0, 0, 1 + (score > low) + (score > high))


def train(texts: Iterable[str], toxic: np.ndarray, n_features: int = 4096, min_g2: float = 20.0) -> OrdinalModel:
    """Model from labelled texts: the ``n_features`` words most tied to a label by likelihood ratio, if by ``min_g2`` at
    least (chance gives 20 to one word in 100,000), then the ordinal fit. Texts are held as numbers of their words."""
    toxic = np.asarray(toxic, dtype=int)
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    if not n0 or not n1:
        return OrdinalModel()
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    found = [np.fromiter(map(known.__getitem__, w), dtype=np.int32, count=len(w)) for w in map(words_of, texts)]
    row, flat = np.repeat(np.arange(len(found)), list(map(len, found))), np.concatenate(found)
    del found
    words = list(known)
    b, a = (np.bincount(flat[toxic[row] == y], minlength=len(words)).astype(float) for y in (0, 1))
    rate = (a + b) / len(toxic)
    cells = ((a, n1 * rate), (b, n0 * rate), (n1 - a, n1 * (1 - rate)), (n0 - b, n0 * (1 - rate)))
    strength = 2 * sum(x * np.log(np.where(x > 0, x, 1) / np.where(x > 0, e, 1)) for x, e in cells)
    chosen = sorted(np.nonzero(strength >= min_g2)[0].tolist(), key=lambda i: (-strength[i], words[i]))[:n_features]
    number = np.full(len(words), -1)
    number[chosen] = np.arange(len(chosen))
    use = number[flat] >= 0
    features = np.split(number[flat[use]], np.cumsum(np.bincount(row[use], minlength=len(toxic)))[:-1])
    w, cuts = fit_ordinal(features, severity_grades(features, toxic, len(chosen)), len(chosen), 4)
    return OrdinalModel({words[j]: float(w[i]) for i, j in enumerate(chosen)}, tuple(map(float, cuts)))


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train_docs: int = 8000) -> OrdinalModel:
    """Fit on at most ``max_train_docs`` labelled rows of ``docs``, those whose ids hash lowest; of an id's labels the least counts. The fit is a task of an
    executor, run again if that is lost; the driver is sent the model alone, a row of at most ``n_features`` words."""
    picked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(label_col).alias("_y")).groupBy("_i").agg(F.min("_y").alias("_y"))
    picked = picked.orderBy(F.xxhash64("_i"), "_i").limit(max_train_docs)
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).join(F.broadcast(picked), "_i")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if got:
            sample = pd.concat(got).sort_values(["_i", "words"])
            m = train(sample["words"], sample["_y"].to_numpy())
            yield pd.DataFrame({"words": [list(m.weights)], "weights": [list(m.weights.values())], "cuts": [list(m.cuts)]})

    # distinct words only: a long text is no larger than its vocabulary
    sample = words_table(rows).groupBy("_i").agg(F.min(F.struct("words", "_y")).alias("x")).select("_i", "x.words", "x._y")  # of a repeated id the least row
    model = sample.coalesce(1).mapInPandas(fit, "words array<binary>, weights array<double>, cuts array<double>").first()
    return OrdinalModel(dict(zip(map(bytes, model.words), model.weights, strict=True)), tuple(model.cuts)) if model else OrdinalModel()


def words_table(rows: DataFrame) -> DataFrame:
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_i": b["_i"], "_y": b["_y"], "words": [b" ".join(sorted(words_of(t))).decode(errors="replace") for t in b["_t"]]})

    return rows.mapInPandas(cut, f"_i {kind['_i']}, _y {kind['_y']}, words string")


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject_from: float = 0.5) -> DataFrame:
    """(id, p0..p3, severity, toxic): ``toxic`` where P(grade >= 1) reaches ``reject_from``. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.array([model.grades(words_of(t)) if model.cuts else [1.0, 0.0, 0.0, 0.0] for t in b["t"]]).reshape(-1, 4)
            yield pd.DataFrame({"i": b["i"], "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2], "p3": p[:, 3], "severity": p @ np.arange(4), "toxic": 1 - p[:, 0] >= reject_from})

    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"i {kind}, p0 double, p1 double, p2 double, p3 double, severity double, toxic boolean")
    return out.withColumnRenamed("i", id_col)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with their own columns; one pass, row by row."""
    if not model.cuts:
        return docs

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        return pd.Series([1 - model.grades(words_of(t))[0] < reject_from for t in texts])

    return docs.where(keeps(F.coalesce(F.col(text_col), F.lit(""))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_on(docs, table(spark, sf_dir, "labels")))


ORACLE: dict[str, str] = {}
