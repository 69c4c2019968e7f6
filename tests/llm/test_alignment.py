"""Alignment against a plain version that encodes whole texts and compares every token's bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from claimspark.llm import alignment as m

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row string, first long, side string, i string, t string, ids string, block string, pair string"


@pytest.fixture(scope="module")
def whole():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = {c: n for n, c in m._byte_characters().items()}

    def tokens(text):
        if not text:
            return [], []
        ia = a.encode(" " + text, add_special_tokens=False).ids
        ta = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in ia]
        tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        raw = (" " + text).encode()
        ok = b"".join(x for _, x in ta) == raw == b"".join(x for _, x in tb)
        return (ta, tb) if ok else ([], [])

    return tokens


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def plain(tokens, texts):
    docs = []
    for i, text in texts:
        sa, sb = map(spans, tokens(text))
        links = [(a, b) for s, e, a in sa for t, f, b in sb if max(s, t) < min(e, f)]
        common = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        groups, low = [], 0
        for c in common:
            groups.append("|".join(",".join(str(x) for s, e, x in side if low <= s and e <= c) for side in (sa, sb)))
            low = c
        docs.append((i, len(sa), len(sb), groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    top = Counter()
    for (a, _), c in count.items():
        top[a] = max(top[a], c)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(i, na, nb, len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest(g)) for i, na, nb, g, links in docs], docs


def texts():
    r = random.Random(4)
    words = ["the", "antidisestablishment", "naïve", "日本語", "x", "zwölf", "don't", "12345", "3.14", "\U0001f600", "<|endoftext|>", "</s>", "<0x41>", "a\nb", "\ttab", "é", "##", " ", "ﬁ"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "  two  spaces   three"), (104, "end "), (105, " start"), (106, "a\n\n b \n c"), (107, "odd ▁ sign"), (108, "\n"), (109, "\x00\x01"), (110, "word▁")]
    return rows + [(5, "again"), (5, "again"), (None, "no id"), (None, None), (200, "long-" * 700)]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
key = lambda r: tuple((x is None, x or 0) for x in r[:1]) + tuple(r[1:])


@pytest.mark.parametrize(("parts", "run", "block", "near"), [(1, 8192, 1_000_000, 1 << 20), (3, 5, 40, 7), (2, 64, 500, 0)])
def test_against_whole_texts(spark, whole, monkeypatch, parts, run, block, near):
    monkeypatch.setattr(m, "RUN_TOKENS", run)
    monkeypatch.setattr(m, "BLOCK_PAIRS", block)
    monkeypatch.setattr(m, "AT_HAND", near)
    docs = spark.createDataFrame([(i, t, *"r", 3, *"sitibp"[:6], "z")[:10] for i, t in texts()], SCHEMA).repartition(parts)
    got = m.alignment_digests(docs, A, B)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(whole, texts())[0], key=key)


def test_groups_and_links(spark, whole):
    rows = texts()[:80]
    got = sorted(((r.doc_id, r.groups, [(x.a, x.b) for x in r.links]) for r in m.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()), key=key)
    assert got == sorted(((i, ";".join(g), links) for i, _, _, g, links in plain(whole, rows)[1]), key=key)


def test_words_in_a_row_are_the_whole_text(whole):
    r, encoder = random.Random(9), m.Encoder(A, B)
    for _ in range(300):
        text = "".join(r.choice("ab \n\t'sé1. 日 ▁-Z ") for _ in range(r.randrange(1, 30)))
        want = whole(text)
        got = encoder.encode(text)
        assert got is None if not want[0] else [x.tolist() for x in got] == [[i for i, _ in t] for t in want]


def test_the_machine_holds_only_the_open_group():
    lengths = [np.array([3]), np.array([4])]
    sweep, most = m.Sweep(lengths, [f"0{e}" for e in ",|;"]), 0
    for _ in range(200):
        for side, n in ((0, 40), (1, 30)):
            sweep.take(side, np.zeros(n, dtype=np.int64))
            most = max(most, len(sweep.ends[0]) + len(sweep.ends[1]))
    assert (sweep.n, sweep.groups, sweep.links) == ([8000, 6000], 2000, 12000) and most <= 40


def test_empty_table(spark):
    assert m.alignment_digests(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    assert m.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
