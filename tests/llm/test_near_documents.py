"""The near_dedup stage: five-word shingles at Jaccard 0.8 against brute force; null and repeated ids."""

import random

import pytest

from claimspark.llm import near_documents, simhash


def jaccard(a, b, n=5):
    a, b = (({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := t.lower().split()) else {()}) for t in (a, b))
    return len(a & b) / len(a | b)


def copies(seed=0):
    """Texts of 200 words, each with copies of one to five replaced words."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = []
    for i in range(25):
        base = [word() for _ in range(200)]
        rows.append((i, " ".join(base)))
        for j in range(1, 6):
            w = list(base)
            for at in r.sample(range(200), j):
                w[at] = word()
            rows.append((100 * j + i, " ".join(w)))
    return rows


def test_groups_against_brute_force(spark):
    rows = copies()
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and jaccard(rows[a][1], rows[b][1]) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    bits = [simhash.fingerprint(t) for _, t in rows]
    assert any((bits[a] ^ bits[root[a]]).bit_count() > 4 for a in range(len(rows)))
    low = {}
    for (i, _), x in zip(rows, root, strict=True):
        low[x] = min(low.get(x, i), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_documents.keep_one_of_near(docs, tile=32)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(low.values())


def test_null_and_repeated_ids_keep_their_different_texts(spark):
    a, b, c, d = (t for _, t in copies(1)[:24:6])
    near = " ".join(["other", *a.split()[1:]])
    rows = [(None, b), (None, c), (None, near), (5, d), (5, a), (5, a), (1, near + " more"), (7, ""), (8, None)]
    got = near_documents.keep_one_of_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} == {(None, b), (None, c), (5, d), (1, near + " more"), (7, "")} and len(got) == 5


def test_more_bits_than_the_anchors_cover_raise(spark):
    with pytest.raises(ValueError, match="anchors"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), most=5)


def test_empty_table(spark):
    assert near_documents.keep_one_of_near(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash_links_are_candidates_by_themselves(spark, monkeypatch):
    rows = copies(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits = {i: simhash.fingerprint(t, 5) for i, t in rows}
    near = [(a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= 4]
    group = {r.fp: r.g for r in near_documents.simhash_keys(docs.toDF("fp", "t"), 5).collect()}
    assert len(near) > 20 and all(group[a] == group[b] for a, b in near)
    text = dict(rows)
    monkeypatch.setattr(near_documents, "document_keys", lambda r, n: r.select("fp", "fp").toDF("g", "fp").limit(0))
    gone = set(bits) - {r.doc_id for r in near_documents.keep_one_of_near(docs).collect()}
    assert gone >= {b for a, b in near if jaccard(text[a], text[b]) >= 0.8}
