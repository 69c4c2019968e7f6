"""Tables that are small on disk and large once they are dealt out are joined by sorted partitions, not sent round whole by the driver."""

from claimspark.operators import components
from claimspark.operators import matching as M
from tests.test_matching import SCHEMA, random_records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_meet_without_a_broadcast(spark, tmp_path):
    M.prepared(spark.createDataFrame(random_records(60, 1), SCHEMA), "key").write.parquet(f"{tmp_path}/rows")
    text = plan(M.candidate_pairs(spark.read.parquet(f"{tmp_path}/rows")))
    met = [line for line in text.splitlines() if "Join" in line and "tile#" in line]
    assert len(met) >= 3 and all("SortMergeJoin" in line for line in met)


def test_components_spread_without_a_broadcast(spark, monkeypatch):
    seen, real = [], components.staged

    def staged(df, label):
        seen.append(plan(df))
        return real(df, label)

    monkeypatch.setattr(components, "staged", staged)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {(r.key, r.primary) for r in components.merge_components(pairs, "a", "b").collect()} == {(i, 0) for i in range(10)}
    assert len(seen) > 2 and not any("Broadcast" in p for p in seen)
