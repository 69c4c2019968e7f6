import random

import pytest
from pyspark.sql import functions as F

from claimspark.operators import claims as C
from claimspark.operators.components import merge_components

SCHEMA = "entity_key string, field string, value double, source_id string, observed_at int, id int"


def test_resolve_prefers_source_then_recency(spark):
    rows = [("e", "f", 1.0, "b", 9, 1), ("e", "f", 2.0, "a", 1, 2), ("e", "f", 3.0, "a", 5, 3), ("e", "f", 9.0, "z", 9, 4)]
    ranked = C.resolve(spark.createDataFrame(rows, SCHEMA), {"f": ["a", "b"]})
    assert {r.id: r.reason for r in ranked.collect()} == {3: "winner", 2: "older observation", 1: "lower priority source", 4: "source not permitted"}
    assert C.disputes(ranked, fields=[ranked.first().field]).first().disputed and not C.disputes(ranked, fields=[]).first().disputed


def test_resolve_without_permitted_source_has_no_winner(spark):
    assert C.resolve(spark.createDataFrame([("e", "f", 1.0, "z", 1, 1)], SCHEMA), {"f": ["a"]}).where("won").count() == 0


def test_unknown_field_raises(spark):
    with pytest.raises(Exception, match="no policy"):
        C.resolve(spark.createDataFrame([("e", "g", 1.0, "a", 1, 1)], SCHEMA), {"f": ["a"]}).collect()


def test_append_new_is_idempotent_and_nulls_never_conflict(spark):
    claims = spark.createDataFrame([("h", 1), ("h", 1), (None, 2)], "content_hash string, v int")
    once = C.append_new(claims, claims.limit(0), ["content_hash"])
    assert once.count() == 2
    assert [r.v for r in C.append_new(claims, once, ["content_hash"]).collect()] == [2]


def test_overrides_last_one_wins_and_expired_do_not(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    given = spark.createDataFrame([(1, 1, "name", "x", False), (2, 1, "name", "y", False), (3, 2, "name", "z", True)], "id int, entity int, field string, value string, expired boolean")
    assert {r.k: r.name for r in C.apply_overrides(rows, given, "k", ["name"]).collect()} == {1: "y", 2: "b"}


@pytest.mark.parametrize("seed", range(3))
def test_merge_components_against_union_find(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(12), r.randrange(12)) for _ in range(8)]
    parent = list(range(12))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    got = merge_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    assert {x.key: x.primary for x in got.collect()} == want


def test_breaker_counts_consecutive_rows(spark):
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate("bbgbbb")], "d string, t int, x string")
    assert [r.t for r in C.breaker_opens(rows, "d", ["t"], F.col("x") == "b").collect()] == [5]
