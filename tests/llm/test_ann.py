import numpy as np

from claimspark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, v string, shard int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in vectors], SCHEMA)


def test_recall_and_scores(spark):
    x = np.random.default_rng(1).normal(size=(900, 16)).astype(np.float32)
    vectors = frame(spark, [(i, v) for i, v in enumerate(x)] + [(10_000, None), (10_100, [0.0] * 16), (10_200, [float("nan")] * 16), (10_300, [None] * 16)])
    got = ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), shard_vectors=300).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hits += len(set(best) & set(g["vec_id"]))
        assert list(g.sort_values("rank")["rank"]) == list(range(1, 11))
        assert np.allclose(g["score"], d[g["vec_id"]], rtol=1e-12)
    assert got["query_id"].nunique() == 9 and hits / 90 >= 0.9


def test_ties_go_to_the_smaller_id_and_few_candidates_are_all_returned(spark):
    vectors = frame(spark, [(i, [1.0, 2.0]) for i in range(40)] + [(50, [1.0, 2.5])])
    got = ann.nearest(vectors, vectors.where("vec_id = 0")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == list(range(1, 11))
    few = frame(spark, [(0, [1.0]), (1, [2.0]), (2, [4.0])])
    assert sorted((r.rank, r.vec_id, r.score) for r in ann.nearest(few, few.where("vec_id = 0")).collect()) == [(1, 1, 1.0), (2, 2, 3.0)]


def test_empty(spark):
    assert ann.nearest(frame(spark, []), frame(spark, [])).count() == 0


def test_recall_over_several_shards_of_full_size(spark):
    r = np.random.default_rng(4)
    x = (r.normal(size=(40, 24))[r.integers(0, 40, 9000)] + 0.4 * r.normal(size=(9000, 24))).astype(np.float32)
    docs = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(docs, docs.where("vec_id % 300 = 0"), shard_vectors=4000).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        hits += len({i for i in np.lexsort((np.arange(len(x)), d)) if i != q and d[i] <= np.sort(d)[10]} & set(g["vec_id"]))
    assert got["query_id"].nunique() == 30 and hits >= 270


def test_a_hub_keeps_all_proposals_and_strays_are_found():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(400, 8)), 1e-3 * r.normal(size=(400, 8))]).astype(np.float32)
    graph, entry = ann.build_graph(x, degree=4, beam=16)
    lost = ann.strays(graph, entry)
    cut = graph.copy()
    cut[cut == 7] = len(x)
    assert set(ann.strays(cut, entry)) >= {7} - {entry} and len(lost) < len(x) // 4


def test_nodes_that_pruning_cut_off_are_linked_again():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(400, 8)), 1e-3 * r.normal(size=(400, 8))]).astype(np.float32)
    for degree, beam in ((4, 16), (8, 16)):
        graph, entry = ann.build_graph(x, degree=degree, beam=beam)
        assert not len(ann.strays(graph, entry)) and graph.shape == (801, degree) and (graph[800] == 800).all()
        again = graph.copy()
        again[0, :] = again[again == 3] = 800  # a node without a way in and one with places left
        before = (again < 800).sum()
        ann.link_strays(x, again, entry)
        assert not len(ann.strays(again, entry)) and (again < 800).sum() > before


def test_what_pruning_cut_off_is_found_at_a_small_degree(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(400, 8)), 1e-3 * r.normal(size=(400, 8))]).astype(np.float32)
    vectors = frame(spark, list(enumerate(x)))
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), degree=4, beam=16).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        hits += len({i for i in np.lexsort((np.arange(len(x)), d)) if i != q and d[i] <= np.sort(d)[10]} & set(g["vec_id"]))
    assert len(got) == 400 and not got.duplicated(["query_id", "vec_id"]).any()
    assert hits >= 350
