"""Visits and what they bring, on the tables at hand, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.functions import text as X
from claimspark.operators import enrichment as N
from claimspark.plans.queries import query
from claimspark.plans.served import INST_SQL, institutions


@query("SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(u, '(?i){p}') THEN 'pattern:{p}'" for p in X.URL_DENY_PATTERNS) + " WHEN page_id % 5 = 0 THEN 'learned:student_data_detected' END AS reason FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url || '/annual-awards' ELSE url || '#' || page_id END AS u FROM pages)")
def blocked_urls(t):
    i = F.col("page_id")
    rows = t("pages").select(i, F.when(i % 4 == 0, F.concat("url", F.lit("/annual-awards"))).otherwise(F.concat("url", F.lit("#"), i.cast("string"))).alias("u"))
    return N.blocked_reason(rows, "u", rows.where("page_id % 5 = 0").select(F.col("u").alias("url"))).select("page_id", "reason")


@query(r"""SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}'), lambda x: NOT regexp_matches(x, '@(?:example|test|localhost|sentry|wordpress|wixpress|godaddy|cloudflare|gmail\.example)|webmaster@|postmaster@|noreply@|no-reply@'))[1] AS email,
 substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS path FROM documents""")
def contacts_and_paths(t):
    return t("documents").select("doc_id", N.first_email(F.col("text")).alias("email"), N.storage_path(F.sha2("text", 256)).alias("path"))


@query("""WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS fee, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS name FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN -o_custkey END AS fee, CASE WHEN o_orderkey % 7 > 0 THEN 'x' END AS name FROM orders WHERE o_orderstatus <> 'O')
SELECT k, coalesce(a.fee, b.fee) AS fee, CASE WHEN a.fee IS NOT NULL THEN 'page' WHEN b.fee IS NOT NULL THEN 'scan' END AS fee_tier, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NOT NULL THEN 'page' WHEN b.name IS NOT NULL THEN 'scan' END AS name_tier FROM a FULL JOIN b USING (k)""")
def read_by_tiers(t):
    k, o = F.col("o_orderkey"), t("orders")
    a = o.where("o_orderstatus <> 'P'").select(k.alias("k"), F.when(k % 2 == 0, F.col("o_custkey")).alias("fee"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("name"))
    b = o.where("o_orderstatus <> 'O'").select(k.alias("k"), F.when(k % 5 > 0, -F.col("o_custkey")).alias("fee"), F.when(k % 7 > 0, "x").alias("name"))
    return N.by_tiers([a, b], ["page", "scan"], "k", ["fee", "name"])


@query(f"WITH {INST_SQL} SELECT id, field, value FROM (SELECT id, phone::VARCHAR AS phone, email::VARCHAR AS email, fee_mid::VARCHAR AS fee_mid, CASE WHEN id % 2 = 0 THEN 'PCM,Arts' END AS streams FROM inst) UNPIVOT (value FOR field IN (phone, email, fee_mid, streams))")
def rows_to_claims(t):
    rows = institutions(t).withColumn("streams", F.when(F.col("id") % 2 == 0, N.streams(F.lit("Physics, Chemistry, Maths and humanities"))))
    return N.to_claims(rows, "id", ["phone", "email", "fee_mid", "streams"])


@query("""SELECT o_orderkey AS k, CASE WHEN abs(v - 50000) <= 5000 OR abs(v - 100000) <= 10000 OR abs(v - 300000) <= 30000 THEN 'near the edge of a band' END AS reason,
 CASE WHEN o_orderkey % 9 = 0 THEN 'no_website' WHEN o_orderkey % 11 IN (0, 6, 7) THEN 'dead_origin' WHEN o_orderkey % 7 = 0 THEN 'login_wall' WHEN o_orderkey % 2 = 1 THEN 'not_found' WHEN o_orderkey % 3 = 0 THEN 'found_fee' ELSE 'found_index' END AS outcome FROM (SELECT *, floor(o_totalprice)::BIGINT AS v FROM orders)""")
def review_and_outcome(t):
    k, v = F.col("o_orderkey"), F.floor("o_totalprice")
    return t("orders").select(k.alias("k"), N.review_reason(v, [50000, 100000, 300000]).alias("reason"), N.outcome(F.when(k % 9 != 0, "s"), F.when((k % 11).isin(6, 7), 503).when(k % 11 > 0, 200), k % 7 == 0, F.when(k % 2 == 0, "u"), F.when(k % 3 == 0, "f")).alias("outcome"))


@query("SELECT page_id, split_part(url, '?', 1) || p AS guess FROM pages, (VALUES ('/a', 1), ('/b', 2), ('/c', 3)) v(p, n) WHERE n <= page_id % 6 - 1")
def guessed_page_urls(t):
    rows = t("pages").select("page_id", F.substring_index("url", "?", 1).alias("base"), (F.col("page_id") % 6).cast("int").alias("budget"))
    return N.guessed_pages(rows, "base", ["/a", "/b", "/c"], "budget").select("page_id", "guess")


@query(f"""WITH {INST_SQL}, l AS (SELECT 'w' || (user_id % 997) AS host, max(ts) AS seen_at FROM events GROUP BY 1), one AS (SELECT website FROM inst WHERE website IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
SELECT id, greatest(last_enriched_at, CASE WHEN website IN (SELECT website FROM one) THEN seen_at END) AS last_enriched_at FROM inst LEFT JOIN l ON host = website""")
def visits_repaired(t):
    log = t("events").select(F.concat(F.lit("w"), (F.col("user_id") % 997).cast("string")).alias("host"), F.col("ts").alias("at"))
    return N.repair_visited(institutions(t), log).select("id", "last_enriched_at")


@query(f"WITH {INST_SQL} SELECT id, CASE WHEN NOT coalesce(last_enriched_at BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-09-01' AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), false) THEN last_enriched_at END AS last_enriched_at FROM inst")
def outage_undone(t):
    claims = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return N.undo_outage(institutions(t), claims, day("1995-03-01"), day("1995-09-01")).select("id", "last_enriched_at")


@query(f"WITH {INST_SQL}, s AS (SELECT round_even(avg(total_enrollment), 0)::BIGINT AS a, round_even(median(total_enrollment), 0)::BIGINT AS b FROM inst) SELECT id, total_enrollment, total_enrollment IS NULL AS guessed, true AS within FROM inst, s")
def guessed_students(t):
    rows = institutions(t)
    s = rows.agg(F.bround(F.avg("total_enrollment")).alias("a"), F.bround(F.median("total_enrollment")).alias("b")).first()
    got = N.guessed_counts(rows, "total_enrollment", "id")
    return got.select("id", "total_enrollment", F.col("guess").isNotNull().alias("guessed"), F.coalesce(F.col("guess").between(min(s.a, s.b), max(s.a, s.b)), F.lit(True)).alias("within"))


@query(f"WITH {INST_SQL} SELECT count(*) AS visited, count(phone) AS phone, count(email) AS email, count(fee_mid) AS fee_mid, round_even(100 * count(phone) / count(*)::DOUBLE, 1) AS phone_pct, round_even(100 * count(email) / count(*)::DOUBLE, 1) AS email_pct, round_even(100 * count(fee_mid) / count(*)::DOUBLE, 1) AS fee_mid_pct FROM inst WHERE last_enriched_at IS NOT NULL")
def enrichment_report(t):
    return N.report(institutions(t).where("last_enriched_at IS NOT NULL"), ["phone", "email", "fee_mid"])
