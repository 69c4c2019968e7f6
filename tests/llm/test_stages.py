"""The stages of the corpus pipeline against plain Python, on null and repeated ids, ties, odd columns and no rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from claimspark.llm import exact_dedup, mixing, near_documents, packing, toxicity

#: Names that the operators might use themselves.
ODD = "key string, _key string, _n int, _i int, _sha string, _digest string, _keep string, _visit int, g long, fp long, row string, Size int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {ODD}"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", "b", 1, 2, "c", "d", "e", 3, 4, 5, "f", 6) for i, t, s in rows], SCHEMA)


def rows_of(df):
    assert df.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert all(tuple(r)[5:] == ("a", "b", 1, 2, "c", "d", "e", 3, 4, 5, "f", 6) for r in df.collect())
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**5)}" for _ in range(n))


def awkward():
    a, b, c, d, e = (text(i) for i in range(5))
    near = c.replace(c.split()[0], "other", 1)
    return [(None, a, "s"), (None, b, None), (None, b, None), (5, c, "s"), (5, d, "t"), (7, c.upper(), "s"), (3, near, "u"), (8, None, "s"), (9, "", "s"), (10, e, "s"), (10, e, "s")]


def test_exact_stage(spark):
    rows = awkward()
    best = {}
    for i, t, s in rows:
        k = (t or "").lower()
        if k not in best or (i is not None, i or 0) >= (best[k][0] is not None, best[k][0] or 0):
            best[k] = (i, t, s)
    assert rows_of(exact_dedup.keep_first_of_equal(table(spark, rows))) == Counter(best.values())


def test_near_stage(spark):
    got = rows_of(near_documents.keep_one_of_near(table(spark, awkward())))
    a, b, c, d, e = (text(i) for i in range(5))
    assert got[(3, awkward()[6][1], "u")] == 1 and not any(t and t.lower() == c for _, t, _ in got)
    assert got[(None, a, "s")] == got[(None, b, None)] == got[(5, d, "t")] == got[(10, e, "s")] == 1
    assert sum(got.values()) == 6 and sum(n for (_, t, _), n in got.items() if not t) == 1


def test_mixing_stage(spark):
    rows = awkward()
    want = mixing.mix_sources(table(spark, rows)).groupBy("doc_id", "size").sum("times").collect()
    got = Counter()
    for (i, t, _), n in rows_of(mixing.mixed_documents(table(spark, rows))).items():
        got[(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))] += n
    assert got == Counter({(r.doc_id, r["size"]): r["sum(times)"] for r in want if r["sum(times)"]})


def test_mix_serves_the_queue_in_order(spark):
    """A plain queue: all visits by finish time, served while the budget lasts."""
    r = random.Random(2)
    rows = [(i, text(i, r.randrange(1, 30)), r.choice("aabc")) for i in range(120)]
    got = mixing.mix_sources(table(spark, rows)).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    by_source = Counter()
    for i, _, s in rows:
        by_source[s] += size[i]
    taken = Counter()
    for x in got:
        taken[rows[x.doc_id][2]] += x.taken
        assert x.taken == x["times"] * size[x.doc_id] and x["times"] <= 3
    target = {rows[x.doc_id][2]: x.target for x in got}
    assert abs(sum(target.values()) - sum(by_source.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 30 for s in target) and sum(taken.values()) <= sum(by_source.values())


@pytest.mark.parametrize("few", [1, 10**6])
def test_the_cut_is_that_of_a_sorted_queue(spark, few):
    r = random.Random(3)
    visits = [(r.random() * 3, r.randrange(3), n, r.randrange(20)) for n in range(300)]
    placed = spark.createDataFrame([(f, k, n, s, 1.0) for f, k, n, s in visits], "f0 double, rank int, row long, size long, target double")
    budget = sum(s for *_, s in visits) // 2
    cut = placed.select(mixing._cut(placed, lambda k: mixing.F.col("f0") + 10 * k, 1, budget, few).alias("c")).first().c
    run, last = 0, None
    for f, k, n, s in sorted(visits):
        if run + s > budget:
            break
        run, last = run + s, (f, k, n)
    served = {v[:3] for v in visits if v[:3] <= (cut[0], cut[1], cut[2])}
    assert served == {v[:3] for v in visits if v[:3] <= last}


def test_toxic_stage_leaves_columns_alone(spark):
    model = toxicity.OrdinalModel({b"vile": 5.0}, (1.0, 2.0, 3.0))
    rows = [*awkward(), (77, "a vile thing", "s"), (None, "VILE, too", None)]
    assert rows_of(toxicity.drop_toxic(table(spark, rows), model)) == Counter(awkward())


@pytest.mark.parametrize("f", [exact_dedup.keep_first_of_equal, near_documents.keep_one_of_near, mixing.mixed_documents])
def test_stages_on_no_rows(spark, f):
    assert f(table(spark, [])).count() == 0


def test_the_pipeline_runs_as_its_stages_do(spark, tmp_path):
    rows = [*awkward(), *[(100 + i, ("vile scum " if i % 4 == 0 else "kind words ") + text(200 + i), "s") for i in range(80)]]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
    assert sizes[:3] == [len(rows) - 20, 67, 66]
    assert {r.doc_id for r in docs.collect()} <= {i for i, *_ in rows}
    count = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert count(corpus_pipeline.run(spark, str(tmp_path))) == count(docs)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("binds, capacity", [(0, (100.0, 100.0, 1e6)), (1, (1000.0, 4.0, 1e6)), (2, (1000.0, 100.0, 6400.0))])
def test_each_capacity_alone_binds(rule, binds, capacity):
    lengths = np.random.default_rng(4).integers(1, 80, 400)
    bins, _ = packing.best_fit(lengths, capacity, (1.0, 1.0, 1.0), rule)
    use = np.array([[lengths[bins == b].sum(), (bins == b).sum(), (lengths[bins == b].astype(float) ** 2).sum()] for b in np.unique(bins)])
    assert (use <= capacity).all()
    least = int(np.ceil(np.array([lengths.sum(), len(lengths), (lengths.astype(float) ** 2).sum()]) / capacity)[binds])
    assert least <= len(use) <= 1.1 * least + 1


def test_sequences_are_near_the_fewest(spark):
    r = random.Random(6)
    pieces = spark.createDataFrame([(i, 0, r.randrange(1, 2049), i) for i in range(3000)], "id long, piece int, length long, ids_crc32 long")
    got = packing.pack(pieces, group_pieces=1024).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= 1.06 * got["length"].sum() / 2048
    few = packing.pack(pieces.limit(200), most_documents=2).toPandas()
    assert few.groupby("sequence_id").size().max() == 2


def test_ordinal_fit_is_a_slow_optimum():
    """At the fit, no step in any direction raises the penalised likelihood of the cumulative-link model."""
    r = np.random.default_rng(6)
    rows = [list(np.nonzero(r.random(3) < 0.5)[0]) for _ in range(300)]
    grade = np.array([min(2, int(sum(x) * 0.6 + r.random())) for x in rows])
    w, cuts = toxicity.fit_ordinal(rows, grade, 3, 3, l2=1e-3, steps=3000, rate=0.02)

    def loss(w, cuts):
        s = np.array([w[x].sum() for x in rows])
        p = lambda k: 1 / (1 + np.exp(s - cuts[k])) if 0 <= k < 2 else np.full(len(rows), float(k >= 2))
        like = np.select([grade == k for k in range(3)], [p(k) - p(k - 1) for k in range(3)])
        return -np.log(like).mean() + 1e-3 / 2 * (w**2).sum()

    best = loss(w, cuts)
    for step in (1e-2, -1e-2):
        for i in range(3):
            assert loss(w + step * np.eye(3)[i], cuts) > best - 1e-7
        for k in range(2):
            assert loss(w, cuts + step * np.eye(2)[k]) > best - 1e-7


def test_the_layout_decides_nothing_of_a_mix(spark):
    """Sixty rows of five ids: the same rows are served, however they lie."""
    r = random.Random(8)
    rows = [(r.randrange(5), text(i, r.randrange(1, 30)), r.choice("aabc")) for i in range(60)]
    mixes = []
    for parts in (1, 3, 7):
        r.shuffle(rows)
        mixes.append(sorted(map(tuple, mixing.mix_sources(table(spark, rows).repartition(parts)).collect())))
    assert mixes[0] == mixes[1] == mixes[2]


def test_packing_leaves_columns_of_any_name(spark):
    pieces = spark.createDataFrame([(i, 0, 700, i, i * 7, -i) for i in range(9)], "id long, piece int, length long, ids_crc32 long, g long, _g long")
    got = packing.pack(pieces, group_pieces=4)
    assert got.columns == [*pieces.columns, "sequence_id", "offset"]
    assert sorted((x.id, x.g, x._g) for x in got.collect()) == [(i, i * 7, -i) for i in range(9)]


def test_of_repeated_labels_the_least_counts(spark):
    docs = spark.createDataFrame([(i, "bad words" if i % 2 else "good words") for i in range(200)], "doc_id long, text string")
    rows = [(i, y) for i in range(200) for y in ((1, 1) if i % 2 else (0, 1))]
    models = [toxicity.train_on(docs, spark.createDataFrame(rows[::step], "doc_id long, toxic int").repartition(parts)) for step, parts in ((1, 1), (-1, 5))]
    assert models[0].weights == models[1].weights and models[0].weights[b"bad"] > 0
