"""Rows of linkage go out by place, once for each key; pairs don't go out again."""

from claimspark.operators import matching as M
from tests.test_matching import SCHEMA, random_records
from tests.test_no_broadcast import plan


def test_complete_rows_meet_by_place_alone(spark, tmp_path):
    """One domain that all rows share deals nothing out where each row has a PIN and a city."""
    rows = [(*r[:2], r[2] or "Pune", *r[3:5], r[5] or "560000", "www.a.in", *r[7:]) for r in random_records(60, 2)]
    M.prepared(spark.createDataFrame(rows, SCHEMA), "key").write.parquet(f"{tmp_path}/rows")
    df = M.candidate_pairs(spark.read.parquet(f"{tmp_path}/rows"), tile=2)
    assert len([line for line in plan(df).splitlines() if "Join" in line and "tile#" in line]) == 2
    got = [(r.a_key, r.b_key) for r in df.select("a_key", "b_key").collect()]
    place = {r[0]: (r[5], r[2]) for r in rows}
    want = {(a, b) for a in place for b in place if a < b and any(x == y for x, y in zip(place[a], place[b], strict=True))}
    assert len(got) == len(set(got)) and set(got) == want


def test_found_pairs_are_not_joined_with_decisions(spark):
    rows = spark.createDataFrame(random_records(60, 3), SCHEMA)
    said = spark.createDataFrame([(k, k + 1, ("same", "different", None, "unsure")[k % 4]) for k in range(59)], "a long, b long, decision string")
    df = M.matched(rows, "key", said)
    assert "FullOuter" not in plan(df)
    bare = {(r.a, r.b): (r.score, r.decision) for r in M.matched(rows, "key").collect()}
    want = {p: x for p, x in bare.items() if p[1] != p[0] + 1 or p[0] % 4 == 2}
    want |= {(k, k + 1): (bare.get((k, k + 1), (None,))[0], "same") for k in range(0, 59, 4)}
    want |= {(k, k + 1): (bare[k, k + 1][0], "unsure") for k in range(3, 59, 4) if (k, k + 1) in bare}
    got = df.collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.score, r.decision) for r in got} == want


def test_merged_pairs_alone_are_those_of_all(spark):
    rows = spark.createDataFrame(random_records(90, 4), SCHEMA)
    said = spark.createDataFrame([(k, k + 2, "same") for k in range(0, 80, 9)], "a long, b long, decision string")
    pairs = [{(r.a, r.b): r.score for r in M.matched(rows, "key", said, review_from=least).where("decision = 'same'").collect()} for least in (M.REVIEW_FROM, M.MERGE_FROM)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 9
