"""Registry rows, PIN places, the queue and evaluation, on the tables at hand, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.operators import jobs as J
from claimspark.operators import registry_rows as R
from claimspark.plans.queries import query

ADDRESS_SQL = "CASE c_custkey % 5 WHEN 0 THEN c_name || ' Road, Ward ' || (c_custkey % 9) || ' , D' || (c_custkey % 30) || ', S' || (c_custkey % 7) || ', 560 0' || (10 + c_custkey % 80) || ', India' WHEN 1 THEN 'D' || (c_custkey % 30) || ',S' || (c_custkey % 7) || ',7441' || (10 + c_custkey % 80) WHEN 2 THEN 'S1, Nepal' WHEN 3 THEN '' ELSE 'Nepal' END"


@query(f"""WITH a AS (SELECT c_custkey AS k, {ADDRESS_SQL} AS line FROM customer)
SELECT k, CASE k % 5 WHEN 0 THEN 'India' WHEN 2 THEN 'Nepal' WHEN 4 THEN 'Nepal' END AS country, CASE k % 5 WHEN 0 THEN '5600' || (10 + k % 80) WHEN 1 THEN '7441' || (10 + k % 80) END AS pincode,
 CASE WHEN k % 5 < 2 THEN 'S' || (k % 7) WHEN k % 5 = 2 THEN 'S1' END AS state, CASE WHEN k % 5 < 2 THEN 'D' || (k % 30) END AS district, CASE WHEN k % 5 = 0 THEN trim(split_part(line, ',', 1)) || ', ' || trim(split_part(line, ',', 2)) END AS address FROM a""")
def addresses(t):
    return t("customer").select(F.col("c_custkey").alias("k"), R.parse_address(F.expr(ADDRESS_SQL)).alias("a")).select("k", "a.*")


@query("""SELECT c_custkey AS k, c_name || ' LANE KARNATAKA' AS address, CASE WHEN c_custkey % 2 = 0 THEN 'www.x' || c_custkey || '.in' END AS website, CASE WHEN c_custkey % 3 = 0 THEN '080' || c_custkey END AS phone FROM customer""")
def labelled_cells(t):
    k = F.col("c_custkey")
    cell = F.concat(F.lit("Address :  "), "c_name", F.lit(" LANE  KARNATAKA "), F.when(k % 2 == 0, F.concat(F.lit("Website : www.x"), k.cast("string"), F.lit(".in "))).otherwise("Website :"), F.when(k % 3 == 0, F.concat(F.lit("PHONE NO: 080"), k.cast("string"))).otherwise(""))
    m = R.split_labelled(cell, ("Address", "Website", "Phone No"))
    return t("customer").select(k.alias("k"), *[F.try_element_at(m, F.lit(x)).alias(n) for x, n in (("Address", "address"), ("Website", "website"), ("Phone No", "phone"))])


PLACES_SQL = "SELECT (560000 + p_partkey % 700)::VARCHAR AS pin, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE (p_partkey % 40)::VARCHAR END AS lat, (60 + p_partkey % 45)::VARCHAR AS lon, p_partkey AS line FROM part"


@query(f"""WITH p AS ({PLACES_SQL}), ok AS (SELECT pin, lat::DOUBLE AS latitude, lon::DOUBLE AS longitude, line FROM p WHERE lat <> 'x' AND lat::DOUBLE BETWEEN 6 AND 37.5 AND lon::DOUBLE BETWEEN 68 AND 97.5),
c AS (SELECT pin, arg_max(latitude, line) AS latitude, arg_max(longitude, line) AS longitude FROM ok GROUP BY pin)
SELECT c_custkey AS k, latitude, longitude, CASE WHEN pin IS NOT NULL THEN 'pin_centroid' END AS geo_precision FROM customer LEFT JOIN c ON pin = (560000 + c_custkey % 900)::VARCHAR""")
def pin_places(t):
    k = F.col("p_partkey")
    table = t("part").select((560000 + k % 700).cast("string").alias("Pin Code"), F.when(k % 11 == 0, "x").otherwise((k % 40).cast("string")).alias("Latitude"), (60 + k % 45).cast("string").alias("lng"), k.alias("line"))
    rows = t("customer").select(F.col("c_custkey").alias("k"), (560000 + F.col("c_custkey") % 900).cast("string").alias("pincode"))
    return R.located(rows, R.centroids(table)).select("k", "latitude", "longitude", "geo_precision")


@query("""WITH s AS (SELECT n_nationkey AS scope, d AS taken_at, 100 + (n_nationkey * 7 + d) % 90 AS row_count FROM nation, range(3) r(d)), n AS (SELECT n_nationkey AS scope, (n_nationkey * 13) % 120 AS n FROM nation)
SELECT scope, n, row_count AS previous, n < 0.5 * row_count AS aborts FROM n JOIN s USING (scope) WHERE taken_at = 2""")
def drift_decisions(t):
    k = F.col("n_nationkey")
    shots = t("nation").select(k.alias("scope"), F.explode(F.array(*map(F.lit, range(3)))).alias("taken_at")).withColumn("row_count", 100 + (F.col("scope") * 7 + F.col("taken_at")) % 90)
    return R.drift(shots, t("nation").select(k.alias("scope"), (k * 13 % 120).alias("n")), ["scope"])


@query("SELECT page_id, 'https://' || split_part(regexp_replace(url, '^https?:/*', ''), '/', 1) AS home FROM pages")
def homepages(t):
    host = F.regexp_extract("url", "://([^/]*)", 1)
    typed = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http:"), host)).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), host, F.lit("// "))).otherwise(F.concat(F.lit("https://"), host, F.lit("/")))
    return t("pages").select("page_id", R.homepage(typed).alias("home"))


JOBS_SQL = """j AS (SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'running' WHEN event_type = 'view' THEN 'done' ELSE 'pending' END AS state, ts AS not_before, event_id % 4 AS attempts, CASE WHEN user_id % 3 > 0 THEN 'k' || (user_id % 40) || event_type END AS dedupe_key FROM events)"""


def _jobs(t):
    e = F.col("event_type")
    state = F.when(e == "click", "running").when(e == "view", "done").otherwise("pending")
    key = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string"), e))
    return t("events").select(F.col("event_id").alias("id"), state.alias("state"), F.col("ts").alias("not_before"), (F.col("event_id") % 4).alias("attempts"), key.alias("dedupe_key"), F.lit(None).cast("string").alias("locked_by"), F.lit(None).cast("timestamp_ntz").alias("locked_at"))


@query(f"""WITH {JOBS_SQL}, old AS (SELECT * FROM j WHERE id % 2 = 0), new AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY id) AS rn FROM j WHERE id % 2 = 1)
SELECT id FROM old UNION ALL SELECT id FROM new WHERE dedupe_key IS NULL OR (rn = 1 AND dedupe_key NOT IN (SELECT dedupe_key FROM old WHERE dedupe_key IS NOT NULL))""")
def queue_enqueue(t):
    jobs = _jobs(t)
    return J.enqueue(jobs.where("id % 2 = 0"), jobs.where("id % 2 = 1")).select("id")


@query(f"""WITH {JOBS_SQL}, due AS (SELECT id FROM j WHERE state = 'pending' AND not_before <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) ORDER BY not_before, id LIMIT 25)
SELECT id, CASE WHEN id IN (SELECT id FROM due) THEN 'running' ELSE state END AS state, attempts + (id IN (SELECT id FROM due))::INT AS attempts, CASE WHEN id IN (SELECT id FROM due) THEN 'w1' END AS locked_by FROM j""")
def queue_claim(t):
    now = t("events").agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("n")).first().n
    return J.claim(_jobs(t), F.lit(now).cast("timestamp_ntz"), "w1", 25).select("id", "state", "attempts", "locked_by")


EVAL_SQL = """g AS (SELECT c_custkey AS k, 'f' || (c_custkey % 5) AS field, c_custkey % 90 AS expected FROM customer),
c AS (SELECT o_custkey AS k, 'f' || (o_orderkey % 5) AS field, arg_max(o_orderkey % 90, (o_orderkey % 7) * 10000000 + o_orderkey) AS value FROM orders GROUP BY ALL),
m AS (SELECT field, value, coalesce(abs(value - expected) <= 20, false) AS hit FROM g LEFT JOIN c USING (k, field))"""


def _gold_and_claims(t):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    gold = t("customer").select(k.alias("entity_key"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("field"), (k % 90).alias("expected"))
    claims = t("orders").select(F.col("o_custkey").alias("entity_key"), F.concat(F.lit("f"), (o % 5).cast("string")).alias("field"), (o % 90).alias("value"), (o % 7).alias("confidence"), o.alias("observed_at"), o.alias("id"))
    return gold, claims


@query(f"""WITH {EVAL_SQL} SELECT field, count(*) AS gold_count, count(value) AS produced, count(*) FILTER (value IS NOT NULL AND hit) AS correct, count(value) - count(*) FILTER (value IS NOT NULL AND hit) AS wrong, count(*) - count(value) AS missing,
 round_even(count(*) FILTER (value IS NOT NULL AND hit) / nullif(count(value), 0)::DOUBLE, 3) AS precision, round_even(count(*) FILTER (value IS NOT NULL AND hit) / count(*)::DOUBLE, 3) AS recall, round_even(count(value) / count(*)::DOUBLE, 3) AS coverage FROM m GROUP BY field""")
def evaluation(t):
    return J.field_scores(*_gold_and_claims(t), F.abs(F.col("value") - F.col("expected")) <= 20)


@query("SELECT DISTINCT c_custkey AS entity_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 > 1)")
def evaluation_unknown(t):
    gold, claims = _gold_and_claims(t)
    return J.unknown_keys(gold, claims.where("confidence > 1"))


@query("""WITH r AS (SELECT l_shipdate::DATE AS run_date, l_returnflag AS extractor, l_linestatus AS field, sum(l_quantity) AS recall FROM lineitem GROUP BY ALL)
SELECT run_date::VARCHAR AS run_date, extractor, field, recall, lag(recall) OVER w AS previous_recall, recall - lag(recall) OVER w AS moved FROM r WINDOW w AS (PARTITION BY extractor, field ORDER BY run_date)""")
def evaluation_history(t):
    r = t("lineitem").groupBy(F.to_date("l_shipdate").alias("run_date"), F.col("l_returnflag").alias("extractor"), F.col("l_linestatus").alias("field")).agg(F.sum("l_quantity").alias("recall"))
    return J.with_previous(r).withColumn("run_date", F.col("run_date").cast("string"))
