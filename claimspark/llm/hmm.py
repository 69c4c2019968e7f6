"""Hidden Markov language model with word classes.

A word is emitted in two steps: the latent state emits its class, the class emits the word by its corpus count. The
``top`` most frequent words are classes of their own (and so certain in theirs); all others share classes by the hash
of their last two bytes, where a word has (c + 1) / (N_k + V_k + 1), unseen words of the class together one share. So
the state tables are bounded however large the vocabulary grows, while counts cover every training token.

One pass counts words. A second writes the texts as class numbers; the commonest words' counts (``lexicon_words``) are
with each task, all others are joined. Counts of neighbouring classes over all training documents give the model that
Baum-Welch begins with: each task adds up expected counts over its blocks by exact forward-backward, Spark sums them by
cell. Scores are exact: the scaled forward recursion over the whole sequence.

Null text counts as empty (its end token alone). A null id counts as the empty string in the split. Repeated rows are
scored each, and columns but id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import BLOCKS, TEXTS, batches_of, stage, table

END = b""  # no word is empty
BLOCK_WORDS = 200_000  # distinct words that a task keeps at hand
BLOCK_TOKENS = 1_000_000
BEFORE = 256  # classes told apart as the one before, when the model to begin with is made


@dataclass
class Hmm:
    start: np.ndarray  # [states]
    move: np.ndarray  # [states, states]
    emit: np.ndarray  # [states, classes]


def in_training(doc_id: str | None) -> bool:
    return zlib.crc32((doc_id or "").encode()) % 7 != 2


def _tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode(errors="replace").lower().split(), END]


def word_counts(docs: DataFrame, id_col: str, text_col: str, most: int = 300_000) -> DataFrame:
    """(word, c) of the training tokens; words are added up in the task first, ``most`` different ones at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()
        row = lambda: pd.DataFrame({"word": list(held), "c": list(held.values())})
        for b in batches:
            for i, t in zip(b["i"], b["t"], strict=True):
                if in_training(i):
                    held.update(_tokens(t))
                    if len(held) > most:
                        yield row()
                        held.clear()
        if held:
            yield row()

    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What a task needs of the counts: the commonest words, and sums of the classes that rarer ones share."""

    tokens: int
    words: int
    own: dict[bytes, int]  # classes of single words
    counts: dict[bytes, int]  # of the commonest words; all words, if there are no more
    whole: bool
    total: np.ndarray  # training tokens of each class
    kinds: np.ndarray  # words of each class
    shared: int

    @property
    def classes(self) -> int:
        return len(self.total)

    def class_of(self, word: bytes) -> int:
        return self.own[word] if word in self.own else len(self.own) + zlib.crc32(word[-2:]) % self.shared


def lexicon_of(counts: DataFrame, top: int, shared: int, most: int) -> Lexicon:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    common = {bytes(r.word): r.c for r in counts.orderBy(F.length("word") > 0, F.desc("c"), "word").limit(most).collect()}  # the end, then ``most`` - 1 words
    own = {w: i for i, w in enumerate([END, *[w for w in common if w != END][:top]])}  # ``most`` above ``top``
    of = F.crc32(F.expr("CASE WHEN length(word) > 2 THEN substring(word, length(word) - 1, 2) ELSE word END")) % shared
    sums = {r.k: (r.n, r.v) for r in counts.groupBy(of.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # ``shared`` rows
    total, kinds = np.zeros(len(own) + shared), np.zeros(len(own) + shared)
    for k, (a, b) in sums.items():
        total[len(own) + k], kinds[len(own) + k] = a, b
    for w, i in own.items():
        c, k = common.get(w, 0), len(own) + zlib.crc32(w[-2:]) % shared
        total[i] = c
        if c:
            total[k], kinds[k] = total[k] - c, kinds[k] - 1
    return Lexicon(int(n), int(v), own, common, v <= most, total, kinds, shared)


ENCODED = (
    "names array<string>, sizes array<int>, learn array<boolean>, cls binary, base array<double>, inner array<double>, known array<long>, "
    "rare array<struct<at:int,word:binary,n:long,k:int>>"
)


def encoded(docs: DataFrame, id_col: str, text_col: str, lexicon: Lexicon) -> DataFrame:
    """Blocks of documents as class numbers, with sums over the words of the lexicon for each document; ``rare`` has the other words of
    document ``at``, whose counts are to be looked up. One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        cls, base, inner, state = [], [], [], []  # by number of a word; state: 1 known, 0 unknown, 2 to be looked up
        wide = lexicon.tokens + lexicon.words + 1

        def number(word: bytes) -> int:
            k, c = lexicon.class_of(word), lexicon.counts.get(word, 0)
            look_up = not c and not lexicon.whole
            cls.append(k)
            state.append(2 if look_up else int(c > 0))
            base.append(0.0 if look_up else np.log10((c + 1) / wide))
            inner.append(0.0 if look_up or k < len(lexicon.own) else np.log10((c + 1) / (lexicon.total[k] + lexicon.kinds[k] + 1)))
            seen[word] = len(cls) - 1
            return len(cls) - 1

        names: list = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []

        def row() -> pd.DataFrame:
            ids = np.concatenate(parts)
            at = np.cumsum(sizes) - sizes
            kind = np.array(state, dtype=np.int64)[ids]
            odd = np.nonzero(kind == 2)[0]
            pairs = Counter(zip(np.repeat(np.arange(len(sizes)), sizes)[odd].tolist(), ids[odd].tolist(), strict=True))
            by_number = list(seen)
            rare = [(d, by_number[w], n, cls[w]) for (d, w), n in pairs.items()]
            sums = lambda values: np.add.reduceat(np.array(values, dtype=float)[ids], at)
            return pd.DataFrame({
                "names": [names], "sizes": [sizes], "learn": [[in_training(i) for i in names]], "cls": [np.array(cls, dtype="<u2")[ids].tobytes()],
                "base": [sums(base)], "inner": [sums(inner)], "known": [np.add.reduceat((kind == 1).astype(np.int64), at)], "rare": [rare],
            })

        for b in batches:
            for i, t in zip(b["i"], b["t"], strict=True):
                tokens = _tokens(t)
                if names and (len(seen) > BLOCK_WORDS or sum(sizes) + len(tokens) > BLOCK_TOKENS):
                    yield row()
                    names, sizes, parts = [], [], []
                    if len(seen) > BLOCK_WORDS:
                        seen.clear()
                        for x in (cls, base, inner, state):
                            x.clear()
                names.append(i)
                sizes.append(len(tokens))
                parts.append(np.fromiter((seen[w] if w in seen else number(w) for w in tokens), dtype=np.int64, count=len(tokens)))
        if names:
            yield row()

    return docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, ENCODED).withColumn("block", F.monotonically_increasing_id())


def rare_sums(blocks: DataFrame, counts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(block, at, base, inner, known): what the words outside the lexicon add to each document."""
    spark = blocks.sparkSession
    shares = spark.createDataFrame([(k, float(a + b + 1)) for k, (a, b) in enumerate(zip(lexicon.total, lexicon.kinds, strict=True))], "k int, share double")
    rare = blocks.select("block", F.explode("rare").alias("r")).select("block", "r.*").join(counts, "word", "left").join(F.broadcast(shares), "k")
    c = F.coalesce("c", F.lit(0))
    base = F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(lexicon.tokens + lexicon.words + 1))))
    return rare.groupBy("block", "at").agg(base.alias("r_base"), F.sum(F.col("n") * F.log10((c + 1) / F.col("share"))).alias("r_inner"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("r_known"))


def _by_length(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, all symbols by time, where each time starts, how many sequences go on at each time), longest first."""
    sizes = np.array([len(s) for s in seqs])
    order = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")
    first = np.concatenate([[0], np.cumsum(active)])
    flat = np.concatenate(seqs)
    begin = (np.cumsum(sizes) - sizes)[order]
    t = np.repeat(np.arange(len(active)), active)
    which = np.arange(len(flat)) - first[t]
    return order, flat[begin[which] + t], first, active


def forward(model: Hmm, seqs: list[np.ndarray], keep: bool = False):
    """log likelihood of each sequence by the scaled forward recursion, all sequences step by step."""
    order, obs, first, active = _by_length(seqs)
    emit = np.ascontiguousarray(model.emit.T)
    log = np.zeros(len(seqs))
    alphas, scales = (np.empty((len(obs), len(model.start))), np.empty(len(obs))) if keep else (None, None)
    a = None
    for t, n in enumerate(active):
        s = slice(first[t], first[t + 1])
        a = (model.start if a is None else a[:n] @ model.move) * emit[obs[s]]
        scale = a.sum(1)
        a /= scale[:, None]
        log[:n] += np.log(scale)
        if keep:
            alphas[s], scales[s] = a, scale
    out = np.empty(len(seqs))
    out[order] = log
    return (out, obs, first, active, emit, alphas, scales) if keep else out


def expected(model: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """Baum-Welch counts of the sequences: start, move and emit in one vector, then the log likelihood."""
    log, obs, first, active, emit, alphas, scales = forward(model, seqs, keep=True)
    k, moves = len(model.start), np.zeros_like(model.move)
    gamma = alphas
    beta = np.ones((active[-1], k))
    for t in range(len(active) - 1, -1, -1):
        s, n = slice(first[t], first[t + 1]), active[t]
        if len(beta) < n:
            beta = np.concatenate([beta, np.ones((n - len(beta), k))])
        if t:
            back = emit[obs[s]] * beta / scales[s, None]
            moves += alphas[first[t - 1] : first[t - 1] + n].T @ back
            gamma_here = alphas[s] * beta
            beta = back @ model.move.T
            gamma[s] = gamma_here
        else:
            gamma[s] = alphas[s] * beta
    classes = model.emit.shape[1]
    emits = np.stack([np.bincount(obs, weights=gamma[:, j], minlength=classes) for j in range(k)])
    return np.concatenate([gamma[: active[0]].sum(0), (moves * model.move).ravel(), emits.ravel(), [log.sum()]])


def maximised(counts: np.ndarray, k: int, classes: int, unigram: np.ndarray) -> Hmm:
    """The model of expected counts; a little of the unigram in each state keeps every class possible."""
    start = counts[:k] + 1.0
    move = counts[k : k + k * k].reshape(k, k) + 1.0
    emit = counts[k + k * k : k + k * k + k * classes].reshape(k, classes) + 5.0 * unigram
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _sequences(r, training: bool) -> list[np.ndarray]:
    cut = np.split(np.frombuffer(r.cls, "<u2").astype(np.int64), np.cumsum(r.sizes)[:-1])
    return [s for s, learn in zip(cut, r.learn, strict=True) if learn] if training else cut


def _grouped(batches: Iterator[pd.DataFrame], most: int = 1_500_000) -> Iterator[list]:
    """Rows of blocks, some at a time: longer lists take fewer steps, ``most`` tokens bound the memory."""
    held, n = [], 0
    for b in batches:
        for r in b.itertuples(index=False):
            held.append(r)
            n += len(r.cls) // 2
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def _summed(df: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in df.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # one row for each cell of the tables
        out[r.cell] = r.n
    return out


def beginning(pairs: np.ndarray, states: int, unigram: np.ndarray, rounds: int = 60, seed: int = 3) -> Hmm:
    """A model to begin with: P(next class | class before) as a mixture over states, by EM on counts of neighbours [before, next]; the
    last row is that of all rarer classes."""
    rng = np.random.default_rng(seed)
    classes, rows = len(unigram), len(pairs)
    before = np.append(unigram[: rows - 1], unigram[rows - 1 :].sum())
    seen = pairs + 1e-3 * pairs.sum() * np.outer(before, unigram) + 1e-9  # no class without a neighbour
    to = rng.gamma(1.0, size=(rows, states)) + 0.5  # P(state | class before)
    to /= to.sum(1, keepdims=True)
    emit = unigram * (rng.gamma(1.0, size=(states, classes)) + 0.5)
    emit /= emit.sum(1, keepdims=True)
    for _ in range(rounds):
        ratio = seen / (to @ emit + 1e-300)
        new_to, emit = to * (ratio @ emit.T), emit * (to.T @ ratio)
        to, emit = new_to / new_to.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)
    move = emit @ to[np.minimum(np.arange(classes), rows - 1)] + 1e-3
    return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), 0.99 * emit + 0.01 * unigram)


def train(blocks: DataFrame, lexicon: Lexicon, states: int = 8, passes: int = 4) -> Hmm:
    """Baum-Welch: ``passes`` over every training document. The model that it starts from is made of counts over all of them too, so
    neither the layout of the table nor a sample of it plays a part."""
    classes = lexicon.classes
    cells = states + states * states + states * classes + 1
    uses = blocks.select("sizes", "learn", "cls")
    unigram = lexicon.total + 1.0
    unigram /= unigram.sum()

    first = min(BEFORE, classes)

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = np.zeros(first * classes, dtype=np.int64)
        for b in batches:
            for r in b.itertuples(index=False):
                if seqs := _sequences(r, True):
                    flat = np.concatenate(seqs)
                    inside = np.ones(len(flat), dtype=bool)
                    inside[np.cumsum([len(x) for x in seqs]) - 1] = False
                    at = np.nonzero(inside)[0]
                    tally += np.bincount(np.minimum(flat[at], first - 1) * classes + flat[at + 1], minlength=len(tally))
        yield pd.DataFrame({"cell": np.nonzero(tally)[0], "n": tally[tally > 0]})

    sums = uses.mapInPandas(neighbours, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = sums.groupBy(F.expr(f"cell div {classes}").alias("before")).agg(F.collect_list(F.struct("cell", "n")).alias("all"))  # ``first`` rows
    pairs = np.zeros(first * classes)
    for r in rows.toLocalIterator():
        got = np.array([tuple(x) for x in r["all"]], dtype=np.int64)
        pairs[got[:, 0]] = got[:, 1]
    model = beginning(pairs.reshape(first, classes), states, unigram)
    for _ in range(passes):

        def count(batches: Iterator[pd.DataFrame], m: Hmm = model) -> Iterator[pd.DataFrame]:
            total = np.zeros(cells)
            for rows in _grouped(batches):
                if seqs := [s for r in rows for s in _sequences(r, True)]:
                    total += expected(m, seqs)
            yield pd.DataFrame({"cell": np.nonzero(total)[0], "n": total[total != 0]})

        model = maximised(_summed(uses.mapInPandas(count, "cell long, n double"), cells), states, classes, unigram)
    return model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = 8, top: int = 1000, shared: int = 256, passes: int = 4, lexicon_words: int = 200_000) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    top: words with a class of their own; shared: classes of all others. Both bound the latent tables whatever the corpus: a rarer word
    has the context of its class alone. lexicon_words: how many counts go to every task; the others are joined.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    with batches_of(spark, TEXTS):
        counts = stage(word_counts(docs, id_col, text_col), "hmm-counts")
        lexicon = lexicon_of(counts, top, shared, lexicon_words)
        blocks = stage(encoded(docs, id_col, text_col, lexicon), "hmm-blocks")
    with batches_of(spark, BLOCKS):
        model = train(blocks, lexicon, states, passes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _grouped(batches):
            log = forward(model, [s for r in rows for s in _sequences(r, False)]) / np.log(10)
            all_ = lambda name: np.concatenate([getattr(r, name) for r in rows])  # noqa: E731, B023
            sizes = [len(r.sizes) for r in rows]
            yield pd.DataFrame({
                "block": np.repeat([r.block for r in rows], sizes), "at": np.concatenate([np.arange(n) for n in sizes]).astype(np.int32), "i": pd.Series([x for r in rows for x in r.names], dtype=object),
                "held_out": ~all_("learn").astype(bool), "n_tokens": all_("sizes").astype(np.int64), "n_known": all_("known"), "base_score": all_("base"), "score": log + all_("inner"),
            })

    out = blocks.drop("rare").mapInPandas(run, "block long, at int, i string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    if not lexicon.whole:
        none = lambda c: F.coalesce(c, F.lit(0))
        out = out.join(rare_sums(blocks, counts, lexicon), ["block", "at"], "left").withColumns({"n_known": F.col("n_known") + none("r_known"), "base_score": F.col("base_score") + none("r_base"), "score": F.col("score") + none("r_inner")})
    return out.select(F.col("i").cast(kind).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(lexicon.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
