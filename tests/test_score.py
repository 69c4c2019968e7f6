from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from claimspark.operators import score as S
from claimspark.streaming.ingest import ingest_claims

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [(49_999, 0), (50_000, 6), (150_000, 30), (1_000_000, 16), (None, None)])
def test_fee_bands_end_before_their_limit(spark, value, want):
    assert one(spark, S.points_upto(F.lit(value).cast("long"), S.FEE_UPTO)) == want


@pytest.mark.parametrize(("pcm", "twelve", "all_", "low", "want"), [(80, 500, 900, 1, (80, False)), (None, 100, 900, 1, (45, True)), (None, None, 1000, None, (60, True)), (None, None, 1000, 6, (None, False))])
def test_headcount_is_observed_or_estimated(spark, pcm, twelve, all_, low, want):
    got = one(spark, S.headcount(*[F.lit(x).cast("int") for x in (pcm, twelve, all_, low)]))
    assert (got.value, got.estimated) == want


def fit_of(spark, **given):
    none, no = F.lit(None), F.lit(False)
    head = S.headcount(*[F.lit(given.get(k)).cast("int") for k in ("pcm", "twelve", "all", "low")])
    boards = F.lit(None).cast("array<string>") if "boards" not in given else F.array(*map(F.lit, given["boards"]))
    parts = S.components(
        fee=F.lit(given.get("fee")).cast("long"), head=head, boards=boards, district=none.cast("string"), metro=F.lit(given.get("metro")).cast("string"), state=F.lit(given.get("state")).cast("string"),
        counsellor=no, principal_fresh=no, email=F.lit(given.get("email", False)), phone=no, campuses=F.lit(given.get("campuses")).cast("int"), franchise=F.lit(given.get("franchise", False)),
    )
    return one(spark, S.fit(parts))


def test_fit_is_a_share_of_what_is_known(spark):
    got = fit_of(spark, fee=200_000, boards=["CBSE", "IB_DP"], metro="Pune")
    assert (got.earned, got.possible, got.fit) == (56.0, 65, 86.2)


def test_fit_needs_forty_points(spark):
    assert tuple(fit_of(spark, fee=200_000)) == (30.0, 35, None)


def test_an_estimated_headcount_weighs_less(spark):
    assert fit_of(spark, twelve=700, boards=["X"]).earned == 0.6 * 25 + 5


def test_a_franchise_is_capped(spark):
    assert fit_of(spark, campuses=25, franchise=True).earned == 1.0
    assert fit_of(spark, campuses=25).earned == 5.0


def test_confidence(spark):
    present = [F.lit(True)] * 4 + [F.lit(False), F.lit(None).cast("boolean")] * 2
    now = F.lit(datetime(2024, 7, 1))
    assert one(spark, S.confidence(present, F.array(F.lit(1), F.lit(4)), F.lit(datetime(2024, 6, 1)), now)) == 62.0
    assert one(spark, S.confidence(present, F.array().cast("array<int>"), F.lit(None).cast("timestamp"), now)) == 30.0


@pytest.mark.parametrize(("args", "want"), [((True, "active", None, None), None), ((None, "active", None, ["PCM"]), "no class 12"), ((True, None, None, None), "not active"), ((True, "active", True, None), "excluded"), ((True, "active", False, ["Arts"]), "no science stream"), ((True, "active", False, []), None)])
def test_gate_names_the_first_reason(spark, args, want):
    row = spark.createDataFrame([args], "a boolean, b string, c boolean, d array<string>")
    assert row.select(S.gate_reason(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).first().x == want


@pytest.mark.parametrize("name", ["fit_score", "confidence", "hard_gate"])
def test_scores_equal_the_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = e.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


def test_ingest_takes_each_claim_once(spark, tmp_path):
    schema = "entity string, field string, value long"
    src, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)
        ingest_claims(spark, src, spark.createDataFrame([], schema).schema, target, log, ["entity", "field", "value"])

    arrive(("a", "fee", 1), ("a", "fee", 1), ("b", "fee", 2))
    arrive(("a", "fee", 1), ("c", "fee", 3), ("d", None, 4))
    arrive(("c", "fee", 3), ("d", None, 4))
    got = spark.read.parquet(target).drop("batch").collect()
    assert sorted(tuple(r) for r in got if r.field) == [("a", "fee", 1), ("b", "fee", 2), ("c", "fee", 3)]
    assert sum(r.field is None for r in got) == 2  # a null in the key never conflicts
