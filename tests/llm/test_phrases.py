"""Phrases against a plain count over all texts; the radix order and the runs by themselves."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from claimspark.llm import phrases as m

SCHEMA = "lang string, text string, word string, hi long, id string, a string, block string"


def plain(rows, least, first=2000, scale=2_000_000, within=80):
    f, n = {}, Counter()
    for lang, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n["und" if lang is None else lang] += len(w)
            c = f.setdefault("und" if lang is None else lang, Counter())
            c.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in cand.items():
            for sub in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                around[sub] = max(around[sub], a)
        kept = []
        for p, a in cand.items():
            if 100 * around[p] < within * a:
                score, k = min((scale * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def rows_of(seed=1, n=400):
    r = random.Random(seed)
    words = ["al", "Be", "ga", "de", "É", "a b", "x\x01", "x", "ze", "-"]
    ends = [" ", " ", "  ", "\t", ", ", ". ", "\n", "; ", " "]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words[: 4 + i % 7]) + r.choice(ends) for _ in range(r.randrange(30)))
        rows.append((r.choice(["en", "de", None, "und", ""]), text, "w", 1, "i", "a", "b"))
    rows += [("en", "new york city hall " * 30, "w", 1, "i", "a", "b")] * 3 + [("en", None, None, None, None, None, None), ("de", "", "", 1, "", "", "")]
    return rows + [("en", "once " * 3000, "w", 1, "i", "a", "b"), ("fr", "never", "w", 1, "i", "a", "b")]


@pytest.mark.parametrize(("parts", "tokens"), [(1, 10_000), (5, 300)])
def test_against_a_plain_count(spark, monkeypatch, parts, tokens):
    rows = rows_of()
    monkeypatch.setattr(m.blocks_of, "__defaults__", (tokens,))
    monkeypatch.setattr(m, "AT_HAND", 3 if parts > 1 else 1000)  # most ids are joined, not at hand
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = m.phrases(docs, least=5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain([(a if a is not None else None, t) for a, t, *_ in rows], 5)


def test_first_and_ties(spark):
    docs = spark.createDataFrame([("en", f"{a} {b}.") for a in "abc" for b in "xyz" for _ in range(3)], "lang string, text string")
    got = sorted(map(tuple, m.phrases(docs, least=3, first=4).collect()))
    assert got == [("en", i, p, 3, 9, 9, 54, 333333) for i, p in enumerate(["a x", "a y", "a z", "b x"], 1)]


def test_empty_table(spark):
    assert m.phrases(spark.createDataFrame([], SCHEMA)).count() == 0
    assert m.phrases(spark.createDataFrame([("en", None), (None, " .,")], "lang string, text string")).count() == 0


def test_radix_order_is_the_lexicographic_one():
    r = np.random.default_rng(3)
    for top in (2, 70_000, 1 << 32):
        columns = [r.integers(0, top, 5000, dtype=np.uint64).astype(np.uint32) for _ in range(3)] + [np.full(5000, 7, dtype=np.uint32)]
        assert (m.radix_order(columns) == np.lexsort(columns[::-1])).all()
    assert len(m.radix_order([np.zeros(0, dtype=np.uint32)] * 4)) == 0


def test_runs_go_on_over_batches_and_partitions(spark):
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2]) << 32 | r.randrange(1, 3), (r.choice([0, 1, 2]) << 32) | 0, r.randrange(1, 4)) for _ in range(3000)]
    rows = [(h, w | (r.randrange(3) if w else 0), n) for h, w, n in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = m.count_runs(spark.createDataFrame(rows, "hi long, lo long, n long"), 20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = Counter()
    for h, w, n in rows:
        want[h, 0] += n
        if w >> 32:
            want[h, w >> 32 << 32] += n
        if w & m.LOW:
            want[h, w] += n
    assert {(g.hi, g.lo): g.a for g in got} == {k: v for k, v in want.items() if v >= 20}


def test_sql_is_the_plain_count():
    import duckdb

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in rows_of(7, 3000)], columns=["lang", "text"]))
    want = plain([r[:2] for r in rows_of(7, 3000)], 30)
    got = con.execute("SELECT lang, rank, phrase, a, l, r, n, score FROM (" + m.ORACLE["op12_phrases"] + ")").fetchall()
    assert sorted(got) == want


def test_a_lang_fills_its_block_whatever_other_langs_hold(spark):
    docs = spark.createDataFrame([(x, "ab cd ef. " * 10) for _ in range(60) for x in ("en", "de", "fr", None)], "lang string, text string").coalesce(1)
    made = m.blocks_of(docs, "lang", "text", 700).collect()
    assert Counter(b.lang for b in made) == {"en": 4, "de": 4, "fr": 4, "und": 4}  # 60 texts of 41 places each; not one for each 700 of all langs
    many = spark.createDataFrame([(str(i % 50), "ab cd " * 10) for i in range(1000)], "lang string, text string").coalesce(1)
    made = m.blocks_of(many, "lang", "text", 300).collect()
    assert sum(sum(b.counts) for b in made) == 20_000 and len(made) > 50  # what a task holds of all langs together is bounded


def test_word_numbers_are_packed_and_ids_are_as_wide_as_they_must():
    r = np.random.default_rng(4)
    codes = np.minimum(r.zipf(1.3, 50_000), 1 << 20).astype(np.uint32)
    small = m.packed(codes)
    assert len(small) < 2.5 * len(codes) and (m.unpacked(small, len(codes)) == codes).all()
    assert (m.unpacked(m.packed(np.array([(1 << 32) - 1, 0, 1 << 24], dtype=np.uint32)), 3) == [(1 << 32) - 1, 0, 1 << 24]).all()
    seq = r.integers(0, 1 << 18, 5000).astype(np.uint32)
    full, slim = m.keys_of(seq), m.keys_of(seq, 18)
    assert int(slim[["hi", "lo"]].to_numpy().max()) < 1 << 36
    for x, y in ((full[c].to_numpy(), slim[c].to_numpy()) for c in ("hi", "lo")):
        assert (x >> 32 == y >> 18).all() and (x & m.LOW == y & ((1 << 18) - 1)).all()


def test_pieces_between_bounds_give_the_same_prefixes(spark):
    r = random.Random(6)
    rows = [(a, b, c, d if c else 0, r.randrange(1, 4)) for a, b, c, d in ([r.randrange(1, 4), r.randrange(1, 4), r.randrange(4), r.randrange(4)] for _ in range(2000))]
    want = sorted(map(tuple, m.count_runs(spark.createDataFrame([(a << 32 | b, c << 32 | d, n) for a, b, c, d, n in rows], "hi long, lo long, n long"), 20).collect()))
    assert len(want) > 50
    for width, bounds in ((2, []), (2, [(1 << 2 | 2, 0), (2 << 2 | 1, 1 << 2 | 2), (2 << 2 | 1, 1 << 2 | 3), (3 << 2 | 3, 15)]), (31, [(2 << 31 | 2, 2 << 31)])):
        made = []
        for s in range(0, len(rows), 500):
            keys = sorted((a << width | b, c << width | d, n) for a, b, c, d, n in rows[s : s + 500])
            hi, lo, n = np.array(keys, dtype=np.int64).T
            cuts = [0, *m.cut_at(hi, lo, tuple(np.array([x[k] for x in bounds], dtype=np.int64) for k in (0, 1))).tolist(), len(hi)]
            for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
                if y > x:
                    piece = m.piece_of(hi[x:y], lo[x:y], n[x:y], width)
                    assert all((u == v).all() for u, v in zip(m.keys_in(*piece.values(), width), (hi[x:y], lo[x:y], n[x:y]), strict=True))
                    assert all(k[:2] < b for k in keys[x:y] for b in bounds[p:]) and all(k[:2] >= b for k in keys[x:y] for b in bounds[:p])
                    made.append((p, *piece.values()))
        got = m.count_pieces(spark.createDataFrame(made, "p int, size int, hi binary, c binary, d binary, n binary"), 20, width)
        assert sorted(map(tuple, got.collect())) == want


def test_packed_keys_take_few_bytes():
    r = np.random.default_rng(8)
    keys = m.keys_of(np.minimum(r.zipf(1.2, 200_000), 1 << 17).astype(np.uint32), 18)
    piece = m.piece_of(*(keys[c].to_numpy() for c in ("hi", "lo", "n")), 18)
    assert sum(len(x) for k, x in piece.items() if k != "size") < 8 * len(keys)  # rows of three numbers took 12 in a shuffle


@pytest.mark.parametrize("places", [50, 1000])
def test_many_ranges_against_a_plain_count(spark, monkeypatch, places):
    rows = rows_of(9)
    monkeypatch.setattr(m.blocks_of, "__defaults__", (300,))
    monkeypatch.setattr(m, "RANGE", places)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert len(m.bounds_of(m.stage(m.blocks_of(docs, "lang", "text"), "b"), m.dictionary_of(m.blocks_of(docs, "lang", "text"), 5), 8)[0]) >= 5
    assert sorted(map(tuple, m.phrases(docs, least=5).collect())) == plain([(a, t) for a, t, *_ in rows], 5)
