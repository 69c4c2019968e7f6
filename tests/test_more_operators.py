"""Small cases of the operators on canonical rows, tables, registries, the queue and visits: nulls, ties, nothing at all."""

import datetime

import pytest
from pyspark.sql import functions as F

from claimspark import config
from claimspark.operators import canonical, enrichment, fees, jobs, registry_rows, served
from claimspark.operators.claims import attributed_once

INST = "id long, canonical_name string, city string, district string, metro_area string, state string, legal_entity_name string, phone string, email string, website string, fee_mid long, total_enrollment long, student_count_guessed long, has_class_12 boolean, status string, last_enriched_at timestamp_ntz, fit double"


def institutions(spark, *rows):
    full = [(i, n, c, d, None, s, None, None, None, None, None, None, None, True, "active", None, None) for i, n, c, d, s in rows]
    return spark.createDataFrame(full, INST)


def ids(df):
    return [r.id for r in df.collect()]


def test_search_by_words_then_by_likeness(spark):
    rows = institutions(spark, (1, "DELHI PUBLIC HALL", "BENGALURU", "X", "KARNATAKA"), (2, "KENDRIYA VIDYALAYA", "PUNE", "Y", "MAHARASHTRA"), (3, None, None, None, None))
    assert ids(served.by_name(rows, "kv")) == [2] and ids(served.by_name(rows, "kendriya vidyalaya pune")) == [2]
    assert ids(served.by_name(rows, "kendriya vidyalaya chennai")) == [] and ids(served.by_name(rows, "zzzqqq")) == []
    assert ids(served.by_name(rows, "vidhyalaya")) == [2]
    assert ids(served.in_city(rows, "y")) == [2] and ids(served.in_state(rows, "Karnataka", contact="none")) == [1]
    assert ids(served.in_state(rows, "Karnataka", contact="verified")) == []
    assert served.known_places(rows).count() == 2 and served.coverage(rows.limit(0)).first().institutions == 0


def test_ids_stay_and_new_ones_follow(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "entity_key string")
    given = spark.createDataFrame([("b", 7), ("z", 9)], "entity_key string, id long")
    got = {r.entity_key: r.id for r in canonical.with_ids(rows, given).collect()}
    assert got["b"] == 7 and sorted(got[k] for k in "acd") == [10, 11, 12]


def test_claims_are_checked(spark):
    rows = spark.createDataFrame([("k", "name", "a\x00b", "seen"), ("k", "name", "c", " "), ("k", "name", "d", None)], "entity_key string, field string, value string, evidence string")
    assert [r.value for r in canonical.checked(rows, ["name"]).collect()] == ["ab"]
    with pytest.raises(Exception, match="unknown field city"):
        canonical.checked(rows.withColumn("field", F.lit("city")), ["name"]).collect()


def test_prune_keeps_all_when_nothing_was_seen(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "entity_key string")
    assert canonical.prune(rows, rows.limit(0)).count() == 2 and canonical.prune(rows, rows.where("entity_key = 'a'")).count() == 1


def test_casts(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [one(canonical.as_bool(F.lit(x).cast("string"))) for x in ("Yes", "0", None)] == [True, False, None]
    assert [one(canonical.as_date(F.lit(x).cast("string"))) for x in ("3/4/2021", "31/02/2021", "2021-04-03", None)] == [datetime.date(2021, 4, 3), None, None, None]
    assert one(canonical.as_list(F.lit("PCM, Arts,"))) == ["PCM", "Arts"] and one(canonical.as_list(F.lit(" "))) is None


def test_scores_are_clamped_and_say_what_is_missing(spark):
    rows = spark.createDataFrame([(1, 95.0, 20), (2, 5.0, -20), (3, None, 10), (4, 50.0, None)], "id int, fit double, boost int")
    got = {r.id: (r.score, r.insufficient, r.flags) for r in canonical.assembled(rows.drop("x"), F.col("fit"), F.col("boost"), {"odd": F.col("id") % 2 == 1}).collect()}
    assert got == {1: (100.0, False, ["odd"]), 2: (0.0, False, []), 3: (0.0, True, ["odd", "insufficient_data"]), 4: (50.0, False, [])}


LABELS = {"fee": ["annual fee"], "fee_total_row": ["total fees"], "fee_total_column": ["total"], "instalment": ["instalment"], "class_12": ["class 12", "xii"], "not_money": ["affiliation"], "result": ["pass percentage"], "strength": ["class wise strength"]}


def fee(spark, *tables):
    rows = [("p", t, r, cells) for t, table in enumerate(tables) for r, cells in enumerate(table)]
    got = fees.annual_fee(spark.createDataFrame(rows, "k string, table_ix int, row_ix int, cells array<string>"), "k", LABELS).collect()
    return got[0].fee if got else None


def test_fees_of_tables(spark):
    assert fee(spark, [["Class", "Annual Fee", "Total"], ["XI", "1000", "40000"], ["XII", "2000", "30000"]]) == 30000
    assert fee(spark, [["Head", "Annual Fee"], ["Tuition", "90000"], ["Total Fees", "182000"]]) == 182000
    part = lambda a, b: [["Class", "Annual Fee instalment"], ["Class 10", a], ["Class 12", b]]
    assert fee(spark, part("50000", "20000"), part("50000", "21000")) == 41000
    assert fee(spark, part("50000", "20000"), [["Class", "Annual Fee instalment"], ["Class 9", "30000"]]) == 20000
    assert fee(spark, [["Affiliation no", "830135"], ["Annual Fee", "http://x.in/202026.pdf"]]) is None
    assert fee(spark, [["Campus area", "40000"]]) is None


def test_addresses_from_the_right(spark):
    one = lambda x: tuple(spark.range(1).select(registry_rows.parse_address(F.lit(x).cast("string")).alias("v")).first().v)
    assert one("1 Road, Ward 2, Pune, Maharashtra, 411 001, India") == ("India", "411001", "Maharashtra", "Pune", "1 Road, Ward 2")
    assert one("Goa, 403001") == (None, "403001", "Goa", None, None) and one(None) == one(" , ") == (None,) * 5


def test_guards(spark):
    rows = spark.createDataFrame([(1, 3, 1, 4), (2, 3, 0, 4)], "page int, parsed int, skipped int, stated int")
    assert registry_rows.row_count_guard(rows.limit(1), "page", "parsed", "skipped", "stated").count() == 1
    with pytest.raises(Exception, match="rows of 2"):
        registry_rows.row_count_guard(rows, "page", "parsed", "skipped", "stated").collect()
    with pytest.raises(ValueError, match="no column for latitude"):
        registry_rows.centroids(spark.createDataFrame([("1", "2")], "pin string, lon string"))


def test_queue_takes_what_waits_longest(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(n, "pending" if n != 2 else "done", t + datetime.timedelta(minutes=5 - n), 0, None, None, k) for n, k in ((1, "a"), (2, None), (3, "b"), (4, None))]
    q = spark.createDataFrame(rows, "id int, state string, not_before timestamp_ntz, attempts int, locked_by string, locked_at timestamp_ntz, dedupe_key string")
    got = {r.id: (r.state, r.attempts) for r in jobs.claim(q, F.lit(t + datetime.timedelta(minutes=3)).cast("timestamp_ntz"), "w").collect()}
    assert got == {1: ("pending", 0), 2: ("done", 0), 3: ("pending", 0), 4: ("running", 1)}
    new = spark.createDataFrame([(9, "pending", t, 0, None, None, k) for k in ("a", "c", "c", None, None)], q.schema)
    assert jobs.enqueue(q, new).count() == 4 + 3


def test_attribution_is_by_substring_and_only_once(spark):
    rows = spark.createDataFrame([(1, "http://ba.com/x"), (2, "http://q.org/?u=A.COM"), (3, "http://none.in"), (4, "http://a.com.b.in/"), (5, None)], "i int, url string")
    sites = spark.createDataFrame([("a.com",), ("a.com.b.in",), ("",)], "site string")
    assert sorted((r.i, r.site) for r in attributed_once(rows, sites, "i", "url", "site").collect()) == [(1, "a.com"), (2, "a.com")]
    assert attributed_once(rows, sites.limit(0), "i", "url", "site").count() == 0


def test_reports_are_written_by_date(spark, tmp_path):
    row = lambda d, v: spark.createDataFrame([(d, "x", "fee", v)], "run_date string, extractor string, field string, recall double")
    for d, v in (("2024-01-01", 0.2), ("2024-01-02", 0.5), ("2024-01-01", 0.3)):
        jobs.write_reports(row(d, v), f"{tmp_path}/r")
    got = jobs.with_previous(spark.read.json(f"{tmp_path}/r")).orderBy("run_date").collect()
    assert [(r.recall, r.previous_recall) for r in got] == [(0.3, None), (0.5, 0.3)]


def test_words_are_a_table_too(spark):
    assert config.table(spark).where("list = 'generic'").count() == len(config.words("generic")) > 10


def test_window_and_homepage(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(enrichment.window(F.lit("abcdefghij"), F.lit("ef"), 2)) == "cdefgh" and one(enrichment.window(F.lit("abc"), F.lit("z"))) is None
    assert [one(registry_rows.homepage(F.lit(x).cast("string"))) for x in ("http:a.in", " a.in/ ", "HTTP://a.in", "", None)] == ["https://a.in", "https://a.in", "HTTP://a.in", None, None]


def test_a_failed_job_is_claimed_again_and_dies_in_the_end(spark):
    """Enqueue, claim, fail, wait, claim: one set of states all the way."""
    from claimspark.operators.claims import queue_step

    t = datetime.datetime(2024, 1, 1)
    at = lambda s: F.lit(t + datetime.timedelta(seconds=s)).cast("timestamp_ntz")
    schema = "id int, state string, attempts int, max_attempts int, not_before timestamp_ntz, locked_by string, locked_at timestamp_ntz, last_error string, finished_at timestamp_ntz, dedupe_key string"
    new = spark.createDataFrame([(1, "pending", 0, 2, t, None, None, None, None, "k"), (2, "pending", 0, 2, t, None, None, None, None, None)], schema)
    ended = lambda *rows: spark.createDataFrame(rows, "id int, error string")
    rows = lambda df: sorted(map(tuple, df.select("id", "state", "attempts", "locked_by", "last_error").collect()))
    q = jobs.claim(jobs.enqueue(new.limit(0), new), at(0), "w", 2)
    q = jobs.finish(q, ended((1, "no route"), (2, None), (7, "x")), at(1))
    assert rows(q) == [(1, "failed", 1, None, "no route"), (2, "done", 1, None, None)]
    q = queue_step(q, at(1)).drop("wait_s")
    assert rows(q)[0] == (1, "pending", 1, None, "no route") and q.where("id = 1").first().not_before == t + datetime.timedelta(seconds=3)
    assert rows(jobs.claim(q, at(2), "w"))[0][1] == "pending"
    q = jobs.claim(q, at(3), "v")
    assert rows(q)[0] == (1, "running", 2, "v", "no route")
    assert rows(queue_step(q, at(3)).drop("wait_s")) == rows(q)  # its lock is fresh
    assert rows(queue_step(q, at(3 + 1801)).drop("wait_s"))[0] == (1, "pending", 2, None, "no route")
    q = queue_step(jobs.finish(q, ended((1, "again")), at(4)), at(4)).drop("wait_s")
    assert rows(q)[0] == (1, "dead", 2, None, "again")


def test_map_places_round_halves_to_even(spark):
    from claimspark.functions import identity

    n, lon = next((n, v) for n in range(1, 3040, 4) if ((v := 68 + 29.5 * n / 3040) - 68) / 29.5 * 760 == n / 4 and n % 8 == 1)  # n / 4 ends in .25, so a half of a tenth
    x = spark.range(1).select(identity.map_point(F.lit(37.5), F.lit(lon)).alias("p"), enrichment.outcome(F.lit("s"), F.lit(200), F.lit(False), F.lit("u"), F.lit(None).cast("string")).alias("o")).first()
    assert (x.p.x, x.o) == (n // 4 + 0.2, "found_index")
