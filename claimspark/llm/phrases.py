"""Phrase collocations: contiguous phrases of two to four frequent words, each judged by its weakest cut.

Texts become blocks of word numbers, each block with a dictionary of its own; the blocks' dictionaries are joined with
that of the corpus, so a word travels once for each block that holds it, not once for each place. Words below ``least``
break the pieces: no phrase that counts can hold one. Every place gives one key of fixed width, the four ids from there on
(two longs of two ids each, zero where the piece ends; an id has as many bits as the largest needs, so that little is sent), so the
phrases of two, three and four words that begin there are the key's prefixes. Each block's keys are put in order by radix sort, added up by run
length and cut into pieces at bounds that are the same for all blocks; a piece travels packed, by differences. The pieces between two
bounds, about ``RANGE`` places, are put in order and counted by run length again, for each prefix length. Only the first and last run
between two bounds can go on beyond them; they are added up by key. Windows of words taken at even distances say where to put the
bounds, nothing else.

Null text counts as empty and null lang as ``und``; ties are settled by phrase; repeated rows count each; very long texts
are blocks of their own; an empty table gives an empty result. Columns but lang and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import TEXTS, batches_of, drop_staged, stage, table
from claimspark.llm.grams import whole_groups

#: Places of a block, and how many times as many a task holds of all langs together.
BLOCK_TOKENS, HELD = 1_500_000, 4
#: Places between two bounds, windows of a block that show where to put them, and pieces that go to Python at once.
RANGE, WINDOWS, PIECES = 1_000_000, 32, 64
#: The commonest words' ids go to every task: as many, of as many bytes at most.
AT_HAND, SHORT = 65_536, 64
BREAK = b"\n"
#: A-Z lower-cased, ends of pieces as line feeds, tabs as spaces.
_AS = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
LOW = (1 << 32) - 1


class _Numbers(dict):
    """word -> its number in the block, from 1; a break is 0."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as bytes: those of one weight stand together, most of the higher ones are zero."""
    bytes_ = numbers.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)
    return pa.compress(np.ascontiguousarray(bytes_.T).tobytes(), codec="zstd", asbytes=True)


def unpacked(numbers: bytes, size: int, kind: str = "<u4") -> np.ndarray:
    each = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(numbers, decompressed_size=each * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(each, -1).T).view(kind)[:, 0]


def blocks_of(docs: DataFrame, lang_col: str, text_col: str, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(block, lang, words, counts, size, codes, windows): word numbers of about ``tokens`` places of one lang, and ``WINDOWS`` times four
    words that follow each other. One pass, no shuffle. A lang's block ends when it is full, or when it is the largest of more than a task
    is to hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}
        total, made = 0, TaskContext.get().partitionId() << 32

        def rows(lang: str) -> Iterator[pd.DataFrame]:
            nonlocal total, made
            numbers, parts = held.pop(lang)
            total -= sizes.pop(lang)
            codes, words = np.concatenate(parts), list(numbers)[1:]
            if words:
                made += 1
                counts = np.bincount(codes, minlength=len(words) + 1)[1:]
                at = np.arange(len(codes) // (2 * WINDOWS), len(codes), -(-len(codes) // WINDOWS))
                windows = [[words[c - 1] if c else BREAK for c in codes[k : k + 4].tolist()] for k in at.tolist()]
                yield pd.DataFrame({"block": [made], "lang": [lang], "words": [words], "counts": [counts], "size": [len(codes)], "codes": [packed(codes)], "windows": [windows]})

        for b in batches:
            for lang, text in zip(b["l"], b["t"], strict=True):
                numbers, parts = held.setdefault(lang, (_Numbers(), []))
                words = list(filter(None, (text or "").encode(errors="replace").translate(_AS).replace(BREAK, b" \n ").split(b" ")))
                parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
                parts.append(np.zeros(1, dtype=np.uint32))
                sizes[lang] = sizes.get(lang, 0) + len(words) + 1
                total += len(words) + 1
                if sizes[lang] >= tokens:
                    yield from rows(lang)
                elif total >= HELD * tokens:
                    yield from rows(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from rows(lang)

    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("l"), F.col(text_col).alias("t"))
    return slim.mapInPandas(run, "block long, lang string, words array<binary>, counts array<long>, size int, codes binary, windows array<array<binary>>")


def dictionary_of(blocks: DataFrame, least: int) -> DataFrame:
    """(lang, word, c, id): words of ``least`` places or more, numbered from 1, the commonest first. A staged table."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    frequent = each.groupBy("lang", "word").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    order = [F.desc("c"), F.col("lang"), F.col("word")]
    rows = frequent.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = stage(rows.withColumn("part", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))), "phrase-words")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = stage(rows.join(before, "part").select("lang", "word", "c", (F.col("before") + F.col("at") + 1).alias("id")), "phrase-dictionary")
    drop_staged(rows)
    return out


def width_of(dictionary: DataFrame) -> int:
    """Bits of the largest id."""
    width = int(dictionary.agg(F.max("id")).first()[0] or 0).bit_length()
    if width > 31:
        raise ValueError("more frequent words than a key of fixed width has room for")
    return width


def ids_of_blocks(blocks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(block, known): number in the block and id of each word that the dictionary holds."""
    near = (F.col("id") <= AT_HAND) & (F.length("word") <= SHORT)
    local = blocks.select("block", "lang", F.posexplode("words").alias("pos", "word"))
    first = local.join(F.broadcast(dictionary.where(near).select("lang", "word", "id")), ["lang", "word"], "left")
    rest = first.where("id IS NULL").drop("id").join(dictionary.where(~near).select("lang", "word", "id"), ["lang", "word"])
    found = first.where("id IS NOT NULL").unionByName(rest).select("block", F.col("pos").cast("int").alias("pos"), F.col("id").cast("int").alias("id"))
    return found.groupBy("block").agg(F.collect_list("pos").alias("pos"), F.collect_list("id").alias("ids"))  # no more than a block has words


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by unsigned 32-bit columns, the first most significant: stable counting sorts of 16-bit digits, the last first."""
    order = None
    for c in reversed(columns):
        for shift in (0, 16):
            digit = (c >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():  # a digit that is the same everywhere orders nothing
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def keys_of(seq: np.ndarray, width: int = 32) -> pd.DataFrame:
    """(hi, lo, n) of the places of a block, sorted and added up: ids of the four words from there on, of ``width`` bits each, zero from
    the first break."""
    w = [seq]
    for k in range(1, 4):
        after = np.zeros_like(seq)
        after[:-k or None] = seq[k:]
        after[w[-1] == 0] = 0
        w.append(after)
    here = (w[0] != 0) & (w[1] != 0)
    w = [c[here] for c in w]
    order = radix_order(w)
    a, b, c, d = (x[order].astype(np.int64) for x in w)
    hi, lo = a << width | b, c << width | d
    starts = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, dtype=np.int64)
    return pd.DataFrame({"hi": hi[starts], "lo": lo[starts], "n": np.diff(np.append(starts, len(hi)))})


def bounds_of(blocks: DataFrame, dictionary: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo), ascending: keys that leave about ``RANGE`` places between two of them, as far as the blocks' windows tell."""
    word = blocks.select("block", "lang", F.posexplode("windows").alias("window", "four")).select("block", "lang", "window", F.posexplode("four").alias("at", "word"))
    found = word.join(dictionary.select("lang", "word", "id"), ["lang", "word"], "left").groupBy("block", "window")
    rows = found.agg(*[F.coalesce(F.max(F.when(F.col("at") == k, F.col("id"))), F.lit(0)).alias(f"w{k}") for k in range(4)]).where("w0 <> 0 AND w1 <> 0").select("w0", "w1", "w2", "w3").toPandas()
    w = [rows[c].to_numpy(dtype=np.int64) for c in rows]
    w[3] = np.where(w[2] == 0, 0, w[3])
    hi, lo = w[0] << width | w[1], w[2] << width | w[3]
    parts = -(-int(blocks.agg(F.sum("size")).first()[0] or 0) // RANGE)
    order = np.lexsort((lo, hi))[np.arange(1, parts) * len(hi) // max(parts, 1)] if len(hi) else np.zeros(0, dtype=np.int64)
    hi, lo = hi[order], lo[order]
    new = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))[: len(hi)]
    return hi[new], lo[new]


def cut_at(hi: np.ndarray, lo: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where in the ascending keys each bound comes: the first key that is not below it."""
    begin, end = np.searchsorted(hi, bounds[0]), np.searchsorted(hi, bounds[0], side="right")
    return np.array([b + np.searchsorted(lo[b:e], x) for b, e, x in zip(begin.tolist(), end.tolist(), bounds[1].tolist(), strict=True)], dtype=np.int64)


def piece_of(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, width: int) -> dict:
    """Ascending keys, packed: differences of hi, those of the third id where hi stays, the fourth, n."""
    c, stays = lo >> width, np.append(False, hi[1:] == hi[:-1])
    step = c - np.where(stays, np.append(0, c[:-1]), 0)
    return {"size": len(hi), "hi": packed(np.diff(hi, prepend=0), "<i8"), "c": packed(step), "d": packed(lo & ((1 << width) - 1)), "n": packed(n, "<i8")}


def keys_in(size: int, hi: bytes, c: bytes, d: bytes, n: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``piece_of`` packed."""
    step, c = unpacked(hi, size, "<i8"), unpacked(c, size).astype(np.int64)
    starts = np.flatnonzero(np.append(True, step[1:] != 0))
    up = np.cumsum(c)
    c = up - np.repeat((up - c)[starts], np.diff(np.append(starts, size)))
    return np.cumsum(step), c << width | unpacked(d, size).astype(np.int64), unpacked(n, size, "<i8")


def pieces(blocks: DataFrame, known: DataFrame, bounds: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    """(p, size, hi, c, d, n): keys of each block, added up in it, and packed between each two bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, codes, pos, ids in zip(b["size"], b["codes"], b["pos"], b["ids"], strict=True):
                codes = unpacked(codes, size)
                id_of = np.zeros(int(codes.max()) + 1, dtype=np.uint32)
                id_of[np.asarray(pos) + 1] = ids
                keys = keys_of(id_of[codes], width)
                hi, lo, n = (keys[c].to_numpy() for c in ("hi", "lo", "n"))
                cuts = [0, *cut_at(hi, lo, bounds).tolist(), len(hi)]
                out = [{"p": p, **piece_of(hi[s:e], lo[s:e], n[s:e], width)} for p, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if e > s]
                if out:
                    yield pd.DataFrame(out)

    joined = blocks.select("block", "size", "codes").join(known, "block").select("size", "codes", "pos", "ids")
    return joined.mapInPandas(run, "p int, size int, hi binary, c binary, d binary, n binary")


def runs_of(least: int, width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From ascending (hi, lo, n), ids of ``width`` bits, to (hi, lo, a) with 32: how often each prefix of two, three and four ids occurs
    there, where that is ``least`` or more or the prefix may go on before or after."""
    low = (1 << width) - 1

    def wide(hi: np.ndarray, lo: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"hi": hi >> width << 32 | hi & low, "lo": lo >> width << 32 | lo & low, "a": a})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[int, tuple[int, int, int]] = {}  # the run of each length that may go on
        begun: set[int] = set()
        for b in batches:
            hi, lo, n = (b[c].to_numpy() for c in ("hi", "lo", "n"))
            out = []
            for k, keep in ((2, 0), (3, -1 << width), (4, -1)):
                here = np.ones(len(hi), dtype=bool) if k == 2 else (lo >> width != 0) if k == 3 else (lo & low != 0)
                h, w, m = hi[here], lo[here] & keep, n[here]
                if not len(h):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
                h, w, m = h[starts], w[starts], np.add.reduceat(m, starts)
                if k in open_:
                    if open_[k][:2] == (h[0], w[0]):
                        m[0] += open_[k][2]
                    else:
                        h, w, m = (np.concatenate([[v], x]) for v, x in zip(open_[k], (h, w, m), strict=True))
                open_[k] = int(h[-1]), int(w[-1]), int(m[-1])
                enough = m[:-1] >= least
                if k not in begun and len(enough):
                    begun.add(k)
                    enough[0] = True
                out.append(wide(h[:-1][enough], w[:-1][enough], m[:-1][enough]))
            yield from out
        if open_:
            yield wide(*np.array(list(open_.values()), dtype=np.int64).T)

    return run


def _enough(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("hi", "lo").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def count_runs(keys: DataFrame, least: int) -> DataFrame:
    """(hi, lo, a): how often each prefix of two, three and four ids occurs in keys (hi, lo, n), where that is ``least`` or more."""
    ordered = keys.repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo")
    return _enough(ordered.mapInPandas(runs_of(least, 32), "hi long, lo long, a long"), least)


def count_pieces(packed_keys: DataFrame, least: int, width: int) -> DataFrame:
    """``count_runs`` of what ``pieces`` gives: the pieces between two bounds meet in one task."""
    low = (1 << width) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in whole_groups(batches, "p"):
            for _, b in some.groupby("p"):
                hi, lo, n = (np.concatenate(x) for x in zip(*(keys_in(*row, width) for row in zip(*(b[c] for c in ("size", "hi", "c", "d", "n")), strict=True)), strict=True))
                order = radix_order([x.astype(np.uint32) for x in (hi >> width, hi & low, lo >> width, lo & low)])
                yield from runs_of(least, width)(iter([pd.DataFrame({"hi": hi[order], "lo": lo[order], "n": n[order]})]))

    met = packed_keys.repartition("p").sortWithinPartitions("p")
    return _enough(met.mapInPandas(run, "hi long, lo long, a long"), least)


#: The ids of a key, as SQL.
IDS = ("shiftright(hi, 32)", f"(hi & {LOW}L)", "shiftright(lo, 32)", f"(lo & {LOW}L)")


def _key(first: int, end: int) -> str:
    """The key of the ids from ``first`` up to ``end`` of a key."""
    w = [*IDS[first:end], *["0L"] * (4 - end + first)]
    return f"struct(shiftleft({w[0]}, 32) | {w[1]} AS hi, shiftleft({w[2]}, 32) | {w[3]} AS lo)"


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, first: int = 2000, scale: int = 2_000_000, within: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each lang by score.

    A phrase of ``a`` places is cut after each word; the cut with the lowest ``scale * a / (l + r)`` (rounded down) counts, l
    and r being the places of its parts. It is left out where a longer phrase around it has ``within`` percent of its places.
    """
    spark = docs.sparkSession
    with batches_of(spark, TEXTS):
        blocks = stage(blocks_of(docs, lang_col, text_col), "phrase-blocks")
    dictionary = dictionary_of(blocks, least)
    known = stage(ids_of_blocks(blocks, dictionary), "phrase-ids")
    width = width_of(dictionary)
    with batches_of(spark, PIECES):
        grams = stage(count_pieces(pieces(blocks, known, bounds_of(blocks, dictionary, width), width), least, width), "phrase-grams")
    drop_staged(known)

    size = f"CASE WHEN {IDS[2]} = 0 THEN 2 WHEN {IDS[3]} = 0 THEN 3 ELSE 4 END"
    parts = {n: ", ".join(f"struct({k} AS k, 'l' AS s, {_key(0, k)} AS p), struct({k} AS k, 'r' AS s, {_key(k, n)} AS p)" for k in range(1, n)) for n in (2, 3, 4)}
    cut = grams.selectExpr("hi", "lo", "a", f"explode(CASE {size} WHEN 2 THEN array({parts[2]}) WHEN 3 THEN array({parts[3]}) ELSE array({parts[4]}) END) AS c")
    cut = cut.selectExpr("hi", "lo", "a", "c.k AS k", "c.s AS s", "c.p.hi AS p_hi", "c.p.lo AS p_lo")
    counts = grams.select("hi", "lo", "a").unionByName(dictionary.selectExpr("shiftleft(id, 32) AS hi", "0L AS lo", "c AS a")).toDF("p_hi", "p_lo", "c")
    sides = cut.join(counts, ["p_hi", "p_lo"]).groupBy("hi", "lo", "a").agg(*[F.expr(f"max(c) FILTER (WHERE k = {k} AND s = '{s}') AS {s}{k}") for k in (1, 2, 3) for s in "lr"])
    score = "cast({scale} AS decimal(9,0)) * cast(a AS decimal(19,0)) div (cast(l{k} AS decimal(19,0)) + cast(r{k} AS decimal(19,0)))"
    cuts = ", ".join(f"CASE WHEN l{k} IS NOT NULL THEN struct({score.format(scale=scale, k=k)} AS score, {k} AS k, l{k} AS l, r{k} AS r) END" for k in (1, 2, 3))
    judged = sides.selectExpr("hi", "lo", "a", f"array_min(array_compact(array({cuts}))) AS c").selectExpr("hi", "lo", "a", "c.l AS l", "c.r AS r", "c.score AS score")

    # a phrase inside one of two words more is inside one of one word more that occurs as often or more
    inner = grams.where(f"{IDS[2]} <> 0").selectExpr("a", f"explode(CASE {size} WHEN 3 THEN array({_key(0, 2)}, {_key(1, 3)}) ELSE array({_key(0, 3)}, {_key(1, 4)}) END) AS p")
    around = inner.groupBy("p.hi", "p.lo").agg(F.max("a").alias("longer"))
    kept = judged.join(around, ["hi", "lo"], "left").where(f"longer IS NULL OR cast(longer AS decimal(19,0)) * 100 < cast(a AS decimal(19,0)) * {within}").drop("longer")

    spelled = kept.selectExpr("*", f"posexplode(array({', '.join(IDS)})) AS (at, id)").where("id > 0").join(dictionary.select("id", "lang", "word"), "id")
    named = spelled.groupBy("hi", "lo", "a", "l", "r", "score", "lang").agg(F.expr("array_sort(collect_list(struct(at, cast(word AS string) AS word))) AS words"))  # four words at most
    named = named.selectExpr("lang", "array_join(words.word, ' ') AS phrase", "a", "l", "r", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = named.withColumn("rank", rank).where(F.col("rank") <= first)
    total = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, row_number() OVER () AS pid, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
tok AS (SELECT lang, pid, unnest(w) AS w, unnest(range(len(w))) AS i FROM words),
spot AS (SELECT lang, w AS p1, p1 || ' ' || lead(w, 1) OVER o AS p2, p2 || ' ' || lead(w, 2) OVER o AS p3, p3 || ' ' || lead(w, 3) OVER o AS p4 FROM tok WINDOW o AS (PARTITION BY pid ORDER BY i)),
gram AS (SELECT lang, 1 AS k, p1 AS phrase, count(*) AS c FROM spot GROUP BY ALL
         UNION ALL SELECT lang, 2, p2, count(*) FROM spot WHERE p2 IS NOT NULL GROUP BY ALL
         UNION ALL SELECT lang, 3, p3, count(*) FROM spot WHERE p3 IS NOT NULL GROUP BY ALL
         UNION ALL SELECT lang, 4, p4, count(*) FROM spot WHERE p4 IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM gram WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM gram WHERE k > 1 AND c >= 30),
cut AS (SELECT lang, k, phrase, a, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y, j FROM cand, (VALUES (1), (2), (3)) AS js(j) WHERE j < k),
scored AS (SELECT cut.lang, cut.k, cut.phrase, a, f.c AS l, s.c AS r, ((2000000::HUGEINT * a) // (f.c::HUGEINT + s.c))::BIGINT AS score, j
           FROM cut JOIN gram f ON f.lang = cut.lang AND f.phrase = cut.x AND f.k = j JOIN gram s ON s.lang = cut.lang AND s.phrase = cut.y AND s.k = cut.k - j),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM scored),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM cand, (VALUES (1), (2), (3)) AS ss(i), (VALUES (2), (3)) AS ms(m) WHERE m < k AND i + m - 1 <= k),
around AS (SELECT lang, phrase, max(a) AS longer FROM longer GROUP BY lang, phrase),
ranked AS (SELECT o.lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank
           FROM lowest o LEFT JOIN around USING (lang, phrase) WHERE place = 1 AND NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
ORACLE = {"op12_phrases": _SQL}
