"""Operators over texts against brute force on small, awkward tables: nulls, empties, ties, repeats, odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from claimspark.llm import common, exact_dedup, hmm, line_dedup, mixing, packing, simhash, token_files, tokens, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, row string, k string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def documents(seed=0, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 90))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12):  # near and exact copies, other case
        w = base[i].split()
        w[r.randrange(len(w))] = r.choice(WORDS)
        rows += [(n + 2 * i, " ".join(w)), (n + 2 * i + 1, base[i].upper())]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "É è é ß É"), (904, "x " * 9000), (905, "solo"), (905, "solo"), (None, "null id"), (906, "a\nA!\n\na b c d e f g h\na b c d e f g i")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if (i or 0) % 7 == 3 else f"s{(i or 0) % 4}", len(t or ""), "x", "y", "z", "q") for i, t in documents()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w]


def slow_fingerprint(t):
    w = words(t)
    hs = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def test_simhash_against_brute_force(docs):
    rows = documents()
    fps = [slow_fingerprint(t) for _, t in rows]
    part = components(len(rows), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    low = {}
    for (i, _), p in zip(rows, part, strict=True):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    want = Counter((i, f"{f:016x}", low.get(p)) for (i, _), f, p in zip(rows, fps, part, strict=True))
    assert Counter(map(tuple, simhash.near_dedup(docs).collect())) == want


def test_anchors_meet_for_every_close_pair():
    r = np.random.default_rng(1)
    for _ in range(300):
        x = r.integers(0, 1 << 63, dtype=np.uint64)
        y = x
        for b in r.choice(64, size=4, replace=False):
            y ^= np.uint64(1) << np.uint64(b)
        _, keys = simhash.anchors(np.array([x, y], dtype=np.uint64))
        at, _ = simhash.anchors(np.array([x, y], dtype=np.uint64))
        assert set(keys[at == 0]) & set(keys[at == 1])


def test_tiles_lose_no_link(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 62, dtype=np.int64)
    fps = sorted({int(base ^ (1 << int(a)) ^ (1 << int(b))) for a, b in r.integers(0, 40, size=(150, 2))} | {int(x) for x in r.integers(0, 1 << 62, size=40)})
    part = components(len(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    got = common.connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), tile=16))
    assert {r.node: r.root for r in got.collect()} == {f: fps[p] for f, p in zip(fps, part, strict=True) if part.count(p) > 1}


def test_exact_dedup(docs):
    rows = documents()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    assert sum(r.kept for r in got) == len(groups)
    by = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert all((r.keep_id, r.group_size) == by[r.text_sha256] for r in got)
    kept = exact_dedup.keep_first_of_equal(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_clashing_digests_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    norm = common.ascii_lower(docs["text"])
    clash = docs.selectExpr("sha2('a', 256) AS digest").limit(1)
    got = exact_dedup._by_bytes(docs, clash, "doc_id", norm).collect()
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in got} == {(1, 3, 2, False), (3, 3, 2, True)}


def test_pfor_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = np.where(r.random(n) < 0.05, r.integers(0, 1 << 32, n), r.integers(0, 900, n)).astype(np.uint32)
        start, body = token_files.pack_blocks(ids)
        assert (token_files.unpack_blocks(start, body, n, 128) == ids).all()
    one = token_files.unpack_blocks(start[7:8], body, 128, 128)
    assert (one == ids[7 * 128 : 8 * 128]).all()


def encoded(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_word_by_word_encoding_is_exact():
    ids = tokens.encoder(tokens.default_tokenizer(), 3)
    for text in ["It's é É é x,y!! 12 a1b <|endoftext|>q  z\u0085 ﬁ", "Σας ΣΑΣ İ", "", "don't_stop 's", "a.. b,, (c) –d"]:
        assert ids(text) == encoded(text, 0)[:-1].tobytes()


def test_token_files(docs, spark):
    path = common.staged_path(spark, "test-files")
    token_files.write_token_files(docs, path, tokens.default_tokenizer(), segment_ids=500)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    rows = documents()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got[:-1]]]))
    want = Counter((i, len(e := encoded(t, 1)), zlib.crc32(e.tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_packing(docs):
    got = packing.pack_documents(docs, tokens.default_tokenizer(), length=64).toPandas()
    want = Counter()
    for i, t in documents():
        ids = encoded(t, 0)
        want.update((i, k, 64 * k, len(ids[64 * k : 64 * k + 64]), zlib.crc32(ids[64 * k : 64 * k + 64].tobytes())) for k in range(-(-len(ids) // 64)))
    rows = got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)
    assert Counter((None if pd.isna(r[0]) else int(r[0]), *map(int, r[1:])) for r in rows) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 64 and (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.random.default_rng(4).integers(1, 101, 300)
    bins, _ = packing.best_fit(lengths, (100.0, 4.0, 6000.0 + 4000.0), rule=rule)
    for b in np.unique(bins):
        x = lengths[bins == b]
        assert x.sum() <= 100 and len(x) <= 4 and (x**2).sum() <= 10000


def test_mixing(docs):
    got = mixing.mix_sources(docs).toPandas()
    rows = documents()
    assert sorted(got["size"]) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows)
    assert (got["taken"] <= 3 * got["size"]).all() and (got["target"] <= 3 * got["source_size"] + 1e-6).all()
    per = got.groupby("source_size").agg(t=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert (abs(per["taken"] - per["t"]) <= per["most"]).all()
    pd.testing.assert_frame_equal(got, mixing.mix_sources(docs).toPandas())


def test_capped_shares_pass_the_excess_on():
    assert mixing.capped_shares([(10, 1.0), (1, 5.0)], 11.0, 3.0) == [8.0, 3.0]


def test_toxicity_on_held_out_texts(spark):
    r = random.Random(5)
    bad = ["vile", "nasty", "awful"]

    def text(y):
        w = [r.choice(WORDS) for _ in range(40)]
        for _ in range(y * r.randrange(2, 6)):
            w[r.randrange(40)] = r.choice(bad) + ","
        return " ".join(w)

    truth = [i % 4 == 0 for i in range(600)]
    docs = spark.createDataFrame([(i, text(y), "k") for i, y in enumerate(truth)] + [(600, None, "k"), (601, "", "k")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(truth[:300])] + [(301, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, toxicity.train_on(docs, labels)).collect()}
    assert len(got) == 602 and not got[600].toxic and not got[601].toxic
    assert np.mean([got[i].toxic == truth[i] for i in range(300, 600)]) > 0.97
    assert all(abs(x.p0 + x.p1 + x.p2 + x.p3 - 1) < 1e-9 for x in got.values())


def test_ordinal_gradient_falls_to_the_optimum():
    r = np.random.default_rng(6)
    rows = [list(np.nonzero(r.random(3) < 0.5)[0]) for _ in range(400)]
    grade = np.array([min(3, int(sum(x) * 0.8 + r.random())) for x in rows])
    w, cuts = toxicity.fit_ordinal(rows, grade, 3, 4)
    assert (np.diff(cuts) > 0).all() and w[2] > w[1] > 0


def test_hmm_forward_and_counts_are_exact():
    r = np.random.default_rng(7)
    m = hmm.Hmm(*(x / x.sum(-1, keepdims=True) for x in (r.random(2), r.random((2, 2)), r.random((2, 3)))))
    seqs = [r.integers(0, 3, n) for n in (1, 4, 2, 4)]

    def paths(s):
        for states in np.ndindex(*[2] * len(s)):
            p = m.start[states[0]] * m.emit[states[0], s[0]]
            for a, b, o in zip(states, states[1:], s[1:], strict=False):
                p *= m.move[a, b] * m.emit[b, o]
            yield states, p

    like = [sum(p for _, p in paths(s)) for s in seqs]
    assert np.allclose(hmm.forward(m, seqs), np.log(like))
    want = np.zeros(2 + 4 + 6)
    for s, z in zip(seqs, like, strict=True):
        for states, p in paths(s):
            want[states[0]] += p / z
            for a, b in zip(states, states[1:], strict=False):
                want[2 + 2 * a + b] += p / z
            for a, o in zip(states, s, strict=True):
                want[6 + 3 * a + o] += p / z
    assert np.allclose(hmm.expected(m, seqs)[:-1], want)


def test_hmm_scores(docs):
    rows = documents()
    c = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            c.update([*words(t), ""])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), ""]), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), ""]), 6)) for i, t in rows)
    got = hmm.score_texts(docs, states=2, top=5, passes=1).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def hmm_scores(docs, **more):
    got = hmm.score_texts(docs, states=2, top=5, shared=4, passes=2, **more).collect()
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got)


def test_hmm_scores_do_not_depend_on_layout_or_lexicon(docs):
    want = hmm_scores(docs.repartition(1))
    assert hmm_scores(docs.repartition(7)) == want
    assert hmm_scores(docs, lexicon_words=6) == want


def test_hmm_score_is_that_of_a_slow_forward_pass(docs):
    counts = hmm.word_counts(docs, "doc_id", "text")
    lexicon = hmm.lexicon_of(counts, 5, 4, 1000)
    blocks = hmm.encoded(docs, "doc_id", "text", lexicon)
    model = hmm.train(blocks, lexicon, 2, 2)
    c = {bytes(r.word): r.c for r in counts.collect()}
    groups = {}
    for w in c:
        groups.setdefault(lexicon.class_of(w), []).append(w)
    got = {str(r.doc_id): r.score for r in hmm.score_texts(docs, states=2, top=5, shared=4, passes=2).collect()}
    for i, t in documents()[:12]:
        tokens = [*(w.encode() for w in words(t)), b""]
        a, total = None, 0.0
        for w in tokens:
            k = lexicon.class_of(w)
            inside = groups.get(k, [])
            share = 1.0 if k < len(lexicon.own) else (c.get(w, 0) + 1) / (sum(c[x] for x in inside) + len(inside) + 1)
            e = model.emit[:, k] * share
            a = [(model.start[s] if a is None else sum(a[q] * model.move[q, s] for q in range(2))) * e[s] for s in range(2)]
            z = sum(a)
            total += np.log10(z)
            a = [x / z for x in a]
        assert abs(got[str(i)] - total) < 1e-6 * max(1.0, abs(total))


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(8)
    for _ in range(500):
        a, b = ("".join(r.choice("ab ") for _ in range(r.randrange(90))) for _ in "12")
        assert line_dedup.edit_distance(a, b) == slow(a, b)
        longer = max(len(a), len(b))
        assert line_dedup.alike(a, b, 0.8) == (slow(a, b) <= 0.2 * longer + 1e-9)


def test_line_dedup_against_brute_force(docs):
    lines = [(i, n, b" ".join(x.split()).decode()) for i, t in documents() for n, x in enumerate((t or "").lower().encode().translate(line_dedup._NORMAL).split(b"\n"))]
    kinds = sorted({x for *_, x in lines if x})
    part = components(len(kinds), lambda a, b: line_dedup.alike(kinds[a], kinds[b], 0.8))
    root = dict(zip(kinds, part, strict=True))
    size = Counter(root[x] for *_, x in lines if x)
    got = line_dedup.dedup_lines(docs).collect()
    assert Counter((r.doc_id, r.line, r.group_size) for r in got) == Counter((i, n, size[root[x]] if x else 1) for i, n, x in lines)
    cleaned = {r.doc_id: r.text for r in line_dedup.cleaned(docs.where("doc_id = 906")).collect()}
    assert cleaned == {906: "a\n\na b c d e f g h\na b c d e f g i"} or cleaned[906].startswith("a\n\na b c d e f g h")


def test_url_filter(spark):
    rows = [("http://A.example.com/en/7?x", "allow", "example.com/en/7"), ("https://x.com/en/8", "block", "com/en/"), ("https://net/de/1#f", "allow", "net/de/"), ("https://notnet/de/1", "allow", None), ("http://q.org/porn-films", "block", None), ("http://q.org/pornography", "allow", None), ("http://q.org/casino", "allow", None), ("http://q.org/casino/poker", "block", None), ("casino poker", "block", None), ("http://casino-win.example.net/x.html", "block", None), ("http://free.q.org/win", "allow", None), ("http://cheap-win.q.org/free", "block", None), (None, "allow", None), ("", "allow", None)]
    pages = spark.createDataFrame([(n, u, "h") for n, (u, *_) in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page_id: (r.verdict, r.rule) for r in url_filter.filter_urls(pages).collect()}
    assert got == {n: (v, r) for n, (_, v, r) in enumerate(rows)}
    assert url_filter.split_url("http://Ab.C?x/y") == ("ab.c", "")


@pytest.mark.parametrize("f", [simhash.near_dedup, exact_dedup.exact_dedup, mixing.mix_sources, line_dedup.dedup_lines, hmm.score_texts, lambda d: packing.pack_documents(d, tokens.default_tokenizer()), lambda d: toxicity.score_toxicity(d, toxicity.OrdinalModel())])
def test_empty_tables(empty, f):
    assert f(empty).count() == 0
