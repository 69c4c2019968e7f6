"""Names compared against a slow table, linkage against all pairs in plain Python, planted variants found."""

import math
import random

import pytest

from claimspark.functions import fuzzy as Z
from claimspark.operators import matching as M


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def slow_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    texts = [" ".join(both), " ".join(both + sorted(x - y)), " ".join(both + sorted(y - x))]
    if both and (x <= y or y <= x):
        return 100.0
    pairs = [(0, 1), (0, 2), (1, 2)] if both else [(1, 2)]
    return max(200.0 * slow_common(texts[i], texts[j]) / (len(texts[i]) + len(texts[j])) for i, j in pairs)


def test_names_against_a_slow_table():
    r = random.Random(1)
    words = ["green", "valley", "public", "st", "mary", "marys", "é", "日本", "a", "ab" * 40]
    for _ in range(1500):
        a, b = (" ".join(r.choice(words) if r.random() < 0.7 else "".join(r.choice("abc") for _ in range(r.randrange(6))) for _ in range(r.randrange(5))) for _ in range(2))
        assert Z.token_set_ratio_of(a, b) == pytest.approx(slow_ratio(a, b))
        assert Z.common_subsequence(a, b) == slow_common(a, b)


def test_pages_of_the_name(spark):
    far = "x " * 3000 + "green valley school"
    rows = [("Green Valley School", "GREEN VALLEY PUBLIC SCHOOL, Bengaluru " + "w " * 50, True), ("Green Valley School", "About zebras and buzzing jazz quartz", False), ("", "anything", True), (None, None, True), ("Green Valley School", far, False), ("Green", None, False)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, name string, text string, want boolean")
    for x in df.withColumn("got", Z.name_on_page(df["name"], df["text"])).collect():
        assert x.got == x.want, x


SCHEMA = "key long, name string, city string, district string, state string, pincode string, website string, phone string, legal_entity string, latitude double, longitude double, udise_code string, cbse_affiliation_no string, block string, score string"


def random_records(n, seed):
    r = random.Random(seed)
    some = lambda *x: r.choice([*x, None]) if r.random() < 0.25 else r.choice(x)
    pins = {f"56000{i}": (12 + i / 20, 77 + i / 30) for i in range(4)} | {"400001": (19.0, 72.8)}
    rows = []
    for k in range(n):
        pin = some(*pins)
        at = pins.get(pin, (None, None))
        name = " ".join(r.sample(["Green", "Valley", "Lotus", "North", "Boys", "Vale"], r.randrange(1, 4)) + ["School"])
        rows.append((k, some(name), some("Pune", "Mysore"), some("D1", "D2"), some("S1"), pin, some("www.a.in", "b.org/x"), some("98000 00001", "9800000002, 9800000003", "9800000003"), some("Lotus Trust"), *at, some("", "1") if r.random() < 0.3 else None, "7" if r.random() < 0.1 else None, "own", "own"))
    return rows


def slow_pairs(rows):
    """All pairs, by the stated rules alone; ``rows`` as prepared by the library, since its columns have tests of their own."""
    out = {}
    for x in rows:
        for y in rows:
            if x.key >= y.key or not set(x.blocks) & set(y.blocks):
                continue
            differ = lambda c: x[c] is not None and y[c] is not None and x[c] != y[c]  # noqa: E731, B023
            odd = set(x.words) ^ set(y.words)
            if (differ("pin") and differ("city")) or differ("udise") or differ("cbse") or (odd and odd <= set(M.BRANCH_WORDS) and differ("pin")):
                continue
            same = lambda c: x[c] is not None and x[c] == y[c]  # noqa: E731, B023
            geo = 0.0
            if x.lat is not None and y.lat is not None:
                p, q = math.radians(x.lat), math.radians(y.lat)
                h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(y.lon - x.lon) / 2) ** 2
                geo = max(0.0, min(1.0, (25 - 2 * 6371 * math.asin(math.sqrt(h))) / 23))
            pin = 1.0 if same("pin") else 0.4 if x.pin and y.pin and x.pin[:3] == y.pin[:3] else 0.0
            score = 0.35 * slow_ratio(x.name_key or "", y.name_key or "") / 100 + 0.25 * pin + 0.15 * same("domain") + 0.1 * bool(set(x.phones) & set(y.phones)) + 0.1 * geo + 0.05 * same("legal")
            if round(score, 6) >= 0.65:
                out[x.key, y.key] = (round(score, 4), "same" if round(score, 6) >= 0.9 else "review")
    return out


@pytest.mark.parametrize("tile", [3, 2000])
def test_linkage_against_all_pairs(spark, tile):
    rows = spark.createDataFrame(random_records(90, 3), SCHEMA)
    want = slow_pairs(M.prepared(rows, "key").collect())
    got = M.matched(rows, "key", tile=tile).collect()
    assert len(got) == len(want) > 50
    assert {(g.a, g.b): (round(g.score, 4), g.decision) for g in got} == want


def test_people_decide_over_scores(spark):
    base = ("Green Valley School", "Pune", "D1", "S1", "560001", "www.gv.in", "9800000001", None, 12.0, 77.0, None, None, "b", "s")
    rows = spark.createDataFrame([(i, *base) for i in range(3)] + [(9, *(None,) * 14)], SCHEMA)
    assert {(x.a, x.b, x.decision) for x in M.matched(rows, "key").collect()} == {(0, 1, "same"), (0, 2, "same"), (1, 2, "same")}
    said = spark.createDataFrame([(1, 0, "different"), (0, 1, "same"), (9, 2, "same")], "a long, b long, decision string")
    got = {(x.a, x.b): (x.decision, x.score) for x in M.matched(rows, "key", said).collect()}
    assert set(got) == {(0, 2), (1, 2), (2, 9)} and got[2, 9] == ("same", None)
    assert M.matched(rows.limit(0), "key").count() == 0


def test_planted_variants(spark):
    """Every tenth customer has a variant; recall and precision of what is merged or shown."""
    from claimspark.plans import matching as P

    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    rows, _ = P.records(t)
    got = {(x.a, x.b): x.decision for x in M.matched(rows, "key").collect()}
    keys = {x.key for x in rows.select("key").collect()}
    planted = {(k - 10**8, k): (k - 10**8) // 10 % 4 for k in keys if k >= 10**8}
    merged = {kind: sum(got.get(p) == "same" for p, k in planted.items() if k == kind) for kind in range(4)}
    size = {kind: sum(k == kind for k in planted.values()) for kind in range(4)}
    found = sum(p in got for p, kind in planted.items() if kind < 3)
    assert found == size[0] + size[1] + size[2] and merged[3] == 0  # all but the branches, of which none is merged
    same = [p for p, d in got.items() if d == "same"]
    assert len(same) > 40 and all(p in planted for p in same)  # nothing else is merged; what is merely alike is for a person to decide
