"""Alignment of two tokenizers' tokens over the bytes of each text: an event sweep.

Both tokenizers cut the same bytes, a space and the text. A token is the event of its end; as an id tells its length, runs
of ids of one side with the offset where the run begins are events packed by the thousand. Events of both sides are
partitioned by document and sorted by offset, and one machine goes through them: where both sides end at one offset, a
group is complete; between two neighbouring ends, whichever side's they are, exactly one token of each side overlaps,
which is a link. The machine holds the tokens of the open group and one run of each side, however long the document.

How many documents hold a pair is counted from blocks of documents, each with its different pairs: a pair travels once
for each block. The commonest pairs (``AT_HAND``) are looked up in the task, all others are joined.

Null and empty texts, and those whose tokens of either side do not spell the bytes, have no tokens: zeros and an empty
digest. Null ids keep their row, repeated rows and ids are documents of their own, very long texts pass in runs; an empty
table gives an empty result. Columns but id and text are not read, whatever their names. Special tokens' strings
in a text are plain text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import BLOCKS, TEXTS, batches_of, drop_staged, stage, table
from claimspark.llm.tokens import _byte_characters

#: Fixed: how byte-level vocabularies cut a text before their merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RUN_TOKENS, BLOCK_PAIRS, WORDS = 8192, 1_000_000, 400_000
#: Pairs whose counts go to every task, 17 bytes each.
AT_HAND = 1 << 20
LOW = (1 << 32) - 1


class ByteLevel(dict):
    """Ids of a byte-level vocabulary (tokenizers library), part by part, and the bytes of each id. Keeps ``WORDS`` parts."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        whole = Tokenizer.from_file(path)
        self.model, self.cut = whole.model, regex.compile(BYTE_LEVEL)
        self.shown = _byte_characters()
        byte_of = {c: b for b, c in self.shown.items()}
        size = whole.get_vocab_size()
        self.bytes = [bytes(byte_of.get(c, 0) for c in whole.id_to_token(i) or "") for i in range(size)]
        if not {bytes([b]) for b in range(256)} <= set(self.bytes):
            raise ValueError("not every byte has an id, so not every text can be spelled")

    def __missing__(self, part: str) -> bytes:
        found = array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.shown))]).tobytes()
        if len(self) < WORDS:
            self[part] = found
        return found

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.cut.findall(text)))

    def word(self, word: str) -> bytes:
        """The ids of a word with the space before it; letters and then signs are two parts."""
        stem = word.rstrip(".,;:!?")
        if stem.isalpha():
            return self[" " + stem] + (self[word[len(stem) :]] if len(stem) < len(word) else b"")
        return self.ids(" " + word)


class Pieces:
    """Ids of a sentencepiece vocabulary, which sets the space itself, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        name = self.model.id_to_piece
        self.bytes = [bytes([int(name(i)[3:5], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def ids(self, text: str) -> bytes | None:
        """None where the pieces don't spell a space and the text."""
        ids = self.model.encode(text)
        return array("I", ids).tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode() else None


class Encoder(dict):
    """A word with the space before it -> ids of both sides; None where B does not spell it (A always does), empty where it
    begins with white space, which may belong to what stands before. Keeps ``WORDS`` words.

    Neither vocabulary joins across a single space before other words, so a text's ids are those of its words in a row.
    """

    def __init__(self, a: str, b: str) -> None:
        super().__init__()
        self.a, self.b = ByteLevel(a), Pieces(b)

    def __missing__(self, word: str) -> tuple[bytes, bytes] | None:
        if word[0].isspace():
            found = ()
        else:
            b = self.b.ids(word)
            found = None if b is None else (self.a.word(word), b)
        if len(self) < WORDS:
            self[word] = found
        return found

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        if not text:
            return None
        words = text.split(" ")
        found = [()] if "" in words else list(map(self.__getitem__, words))
        if () in found:  # white space in a row, or at an end
            b = self.b.ids(text)
            found = [None if b is None else (self.a.ids(" " + text), b)]
        if None in found:
            return None
        return tuple(np.frombuffer(b"".join([f[i] for f in found]), dtype="<u4") for i in (0, 1))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(a: str, b: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return _ENCODERS.get((a, b)) or _ENCODERS.setdefault((a, b), Encoder(a, b))


def end_events(docs: DataFrame, a: str, b: str, id_col: str, text_col: str) -> DataFrame:
    """(row, first, side, id, ids): packed end events of both sides, 1 and 2, and one row of side 0 for each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, pack = _encoder(a, b), zstandard.ZstdCompressor(level=1).compress
        lengths = [np.fromiter(map(len, side.bytes), dtype=np.int64) for side in (encoder.a, encoder.b)]
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for i, text in zip(batch["i"], batch["t"], strict=True):
                row += 1
                out.append((row, -1, 0, None if pd.isna(i) else i, b""))
                for side, ids in enumerate(encoder.encode(text) or (), 1):
                    first = 0
                    for at in range(0, len(ids), RUN_TOKENS):
                        part = ids[at : at + RUN_TOKENS]
                        out.append((row, first, side, None, pack((part.astype("<u2") if len(lengths[side - 1]) <= 1 << 16 else part).tobytes())))
                        first += int(lengths[side - 1][part].sum())
            yield pd.DataFrame(out, columns=["row", "first", "side", "i", "ids"])

    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return slim.mapInPandas(run, f"row long, first long, side int, i {kind}, ids binary")


class Sweep:
    """The machine: takes runs of either side by offset, gives out complete groups (as text) and links (as pairs of ids)."""

    def __init__(self, lengths: list[np.ndarray], names: list[str]) -> None:
        self.lengths, self.names = lengths, names
        none = np.zeros(0, dtype=np.int64)
        self.ends, self.ids = [none, none], [none, none]  # of the tokens whose group is open
        self.upto, self.n, self.groups, self.links = [0, 0], [0, 0], 0, 0

    def take(self, side: int, ids: np.ndarray) -> tuple[str, np.ndarray] | None:
        ends = self.upto[side] + np.cumsum(self.lengths[side][ids])
        self.upto[side] = int(ends[-1])
        self.n[side] += len(ids)
        self.ends[side], self.ids[side] = np.concatenate([self.ends[side], ends]), np.concatenate([self.ids[side], ids.astype(np.int64)])
        common = np.intersect1d(*self.ends, assume_unique=True)
        if not len(common):
            return None
        at = [int(np.searchsorted(e, common[-1], "right")) for e in self.ends]
        (ea, eb), (ia, ib) = ([x[:n] for x, n in zip(y, at, strict=True)] for y in (self.ends, self.ids))
        self.ends, self.ids = ([x[n:] for x, n in zip(y, at, strict=True)] for y in (self.ends, self.ids))
        every = np.union1d(ea, eb)  # between two of these one token of each side
        pairs = ia[np.searchsorted(ea, every)] << 32 | ib[np.searchsorted(eb, every)]
        ga, gb = np.searchsorted(common, ea), np.searchsorted(common, eb)
        text = np.empty(len(ea) + len(eb), dtype=np.int64)
        text[np.arange(len(ea)) + np.searchsorted(gb, ga)] = 3 * ia + (ea == common[ga])
        text[np.arange(len(eb)) + np.searchsorted(ga, gb, "right")] = 3 * ib + 2 * (eb == common[gb])
        begun = self.groups > 0
        self.groups += len(common)
        self.links += len(every)
        return (";" if begun else "") + "".join(map(self.names.__getitem__, text.tolist()))[:-1], pairs


def sweeps(events: DataFrame, a: str, b: str, open_block, add_part, end_document, close_block, schema: str) -> DataFrame:
    """Runs the machine over each document's events in order of offset and hands what it gives out to the four functions of a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, unpack = _encoder(a, b), zstandard.ZstdDecompressor().decompress
        lengths = [np.fromiter(map(len, side.bytes), dtype=np.int64) for side in (encoder.a, encoder.b)]
        names = [f"{i}{end}" for i in range(max(map(len, lengths))) for end in ",|;"]
        block, sweep, doc = open_block(), None, None
        for batch in batches:
            for _, side, i, ids in zip(batch["row"], batch["side"], batch["i"], batch["ids"], strict=True):
                if side == 0:
                    if sweep is not None and end_document(block, doc, sweep):
                        yield close_block(block)
                        block = open_block()
                    sweep, doc = Sweep(lengths, names), None if pd.isna(i) else i
                else:
                    got = sweep.take(side - 1, np.frombuffer(unpack(ids), dtype="<u2" if len(lengths[side - 1]) <= 1 << 16 else "<u4"))
                    if got:
                        add_part(block, *got)
        if sweep is not None:
            end_document(block, doc, sweep)
            yield close_block(block)

    return events.repartition("row").sortWithinPartitions("row", "first", "side").mapInPandas(run, schema)


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups, links) of each document: groups as ``a1,a2|b1;a3|b2,b3``, links as (a, b) in order of offset."""
    kind = docs.schema[id_col].dataType.simpleString()

    def close(block: dict) -> pd.DataFrame:
        return pd.DataFrame(block["rows"], columns=["i", "groups", "links"])

    def add(block: dict, text: str, pairs: np.ndarray) -> None:
        block["text"].append(text)
        block["links"] += [{"a": int(p >> 32), "b": int(p & LOW)} for p in pairs]

    def end(block: dict, doc, sweep: Sweep) -> bool:
        block["rows"].append((doc, "".join(block["text"]), block["links"]))
        block["text"], block["links"] = [], []
        return len(block["rows"]) >= 64

    with batches_of(docs.sparkSession, TEXTS):
        events = stage(end_events(docs, a, b, id_col, text_col), "align-events")
    out = sweeps(events, a, b, lambda: {"rows": [], "text": [], "links": []}, add, end, close, f"i {kind}, groups string, links array<struct<a:int,b:int>>")
    return out.withColumnRenamed("i", id_col)


class _Block:
    """Documents and their different pairs, until ``BLOCK_PAIRS`` are held."""

    def __init__(self) -> None:
        self.digest, self.parts, self.held = None, [], 0
        self.docs, self.pairs, self.times = [], [], []

    def add(self, text: str, pairs: np.ndarray) -> None:
        self.digest = self.digest or hashlib.sha256()
        self.digest.update(text.encode())
        self.parts.append(np.unique(pairs, return_counts=True))

    def end(self, doc, sweep: Sweep) -> bool:
        pairs, times = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, dtype=np.int64),) * 2
        if len(self.parts) > 1:
            pairs, at = np.unique(pairs, return_inverse=True)
            times = np.bincount(at, times).astype(np.int64)
        self.docs.append((doc, *sweep.n, sweep.groups, sweep.links, self.digest.hexdigest() if self.digest else "", len(pairs)))
        self.pairs.append(pairs)
        self.times.append(times)
        self.held += len(pairs)
        self.digest, self.parts = None, []
        return self.held >= BLOCK_PAIRS or len(self.docs) >= 100_000

    def close(self) -> pd.DataFrame:
        pairs, codes, holds = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        columns = dict(zip(("ids", "n_a", "n_b", "n_groups", "n_links", "digests", "sizes"), ([list(c)] for c in zip(*self.docs, strict=True)), strict=True))
        steps = np.diff(codes, prepend=0).astype("<i4").tobytes()  # small where a document's pairs are in order
        return pd.DataFrame({**columns, "pairs": [pairs], "holds": [holds], "steps": [steps], "times": [np.concatenate(self.times).astype("<u4").tobytes()]})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, c, best): how many documents hold each pair, and whether no pair of its A id has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "holds")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holds").alias("c"))
    return each.groupBy("pair").agg(F.sum("c").alias("c")).selectExpr("pair", "c", "c = max(c) OVER (PARTITION BY shiftright(pair, 32)) AS best")  # an A id has no more pairs than B has ids


def alignment_digests(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    count_sum: over its links, how many documents hold the link's pair. n_best: its links whose pair has the highest count of its A id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    with batches_of(docs.sparkSession, TEXTS):
        schema = f"ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, sizes array<int>, pairs array<long>, holds array<long>, steps binary, times binary"
        blocks = sweeps(end_events(docs, a, b, id_col, text_col), a, b, _Block, _Block.add, _Block.end, _Block.close, schema)
        blocks = stage(blocks.withColumn("block", F.monotonically_increasing_id()), "align-blocks")
    counts = stage(pair_counts(blocks), "align-pairs")
    near = stage(counts.orderBy(F.desc("c"), "pair").limit(AT_HAND).orderBy("pair"), "align-near")
    at_hand = near.toPandas().sort_values("pair")
    known, c_of, best_of = at_hand["pair"].to_numpy(np.int64), at_hand["c"].to_numpy(np.int64), at_hand["best"].to_numpy(bool)
    rare = blocks.select("block", F.posexplode("pairs").alias("pos", "pair")).join(F.broadcast(near.select("pair")), "pair", "left_anti").join(counts, "pair")
    rare = rare.groupBy("block").agg(F.collect_list("pos").alias("pos"), F.collect_list("c").alias("c"), F.collect_list("best").alias("best"))  # no more than a block has pairs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b_ in batches:
            for r in b_.itertuples(index=False):
                pairs = np.asarray(r.pairs, dtype=np.int64)
                c, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    hit = known[at] == pairs
                    c[hit], best[hit] = c_of[at[hit]], best_of[at[hit]]
                if r.pos is not None and len(r.pos):
                    pos = np.asarray(r.pos, dtype=np.int64)
                    c[pos], best[pos] = r.c, np.asarray(r.best, dtype=bool)
                codes, times = np.cumsum(np.frombuffer(r.steps, dtype="<i4").astype(np.int64)), np.frombuffer(r.times, dtype="<u4").astype(np.int64)
                ends = np.cumsum(np.asarray(r.sizes, dtype=np.int64))
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])  # noqa: E731, B023
                yield pd.DataFrame({"i": list(r.ids), "n_a": r.n_a, "n_b": r.n_b, "n_groups": r.n_groups, "n_links": r.n_links, "n_best": total(times * best[codes]), "count_sum": total(times * c[codes]), "groups_sha256": r.digests})

    with batches_of(docs.sparkSession, BLOCKS):
        joined = blocks.drop("holds").join(rare, "block", "left").drop("block")
        out = stage(joined.mapInPandas(run, f"i {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), "align-documents")
    drop_staged(blocks, counts, near)
    return out.withColumnRenamed("i", id_col)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


ORACLE: dict[str, str] = {}
