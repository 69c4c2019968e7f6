import pytest

from claimspark.llm import toxicity


@pytest.mark.parametrize("rows", [[], [("a b", 1), ("c", 1)], [("a b", None), ("c", 0)], [(None, 1), ("", 0)]])
def test_too_few_labels_give_a_model_that_rejects_nothing(spark, rows):
    docs = spark.createDataFrame([(f"d{i}", t) for i, (t, _) in enumerate(rows)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", y) for i, (_, y) in enumerate(rows)], "doc_id string, toxic int")
    model = toxicity.train_on(docs, labels)
    assert model.weights == {}
    assert toxicity.drop_toxic(docs, model).count() <= len(rows)


def test_the_fit_of_a_task_is_that_of_the_texts(spark):
    texts = [f"{'vile scum' if i % 2 else 'kind words'} w{i % 7}" for i in range(120)] + [None]
    docs = spark.createDataFrame([(f"d{i:03}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i:03}", i % 2) for i in range(121)], "doc_id string, toxic int")
    model = toxicity.train_on(docs, labels)
    assert set(model.weights) == {b"vile", b"scum", b"kind", b"words"}
    assert model.weights[b"vile"] > 0 > model.weights[b"kind"]
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept >= {f"d{i:03}" for i in range(0, 120, 2)} and not kept & {f"d{i:03}" for i in range(1, 120, 2)}
