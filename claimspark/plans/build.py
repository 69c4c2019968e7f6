"""Canonical rows and scores out of claims made of orders, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.operators import canonical as B
from claimspark.operators import claims as C
from claimspark.operators.components import merge_components
from claimspark.plans.queries import query

FIELDS = ("name", "city", "district", "website", "fee_annual_inr", "total_enrollment", "has_class_12", "status", "principal_name", "streams", "board_valid_from")
SOURCES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
LOG_SQL = """log AS (SELECT CASE o_custkey % 4 WHEN 0 THEN 'cbse:' WHEN 1 THEN 'cisce:' WHEN 2 THEN 'udise:' ELSE 'odd:' END || (o_custkey % 400) AS entity_key,
 CASE o_orderkey % 11 WHEN 0 THEN 'name' WHEN 1 THEN 'city' WHEN 2 THEN 'district' WHEN 3 THEN 'website' WHEN 4 THEN 'fee_annual_inr' WHEN 5 THEN 'total_enrollment' WHEN 6 THEN 'has_class_12' WHEN 7 THEN 'status' WHEN 8 THEN 'principal_name' WHEN 9 THEN 'streams' ELSE 'board_valid_from' END AS field,
 CASE o_orderkey % 11 WHEN 0 THEN 'Name ' || o_orderkey WHEN 1 THEN 'Poona' WHEN 2 THEN 'Bellary' WHEN 3 THEN 'https://www.s' || (o_orderkey % 90) || '.in/x' WHEN 4 THEN (o_orderkey % 90) || ',500.7' WHEN 5 THEN (o_orderkey % 900)::VARCHAR
 WHEN 6 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END WHEN 7 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'disaffiliated' ELSE 'active' END WHEN 8 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Dr. ' ELSE '' END || 'P ' || (o_orderkey % 70) WHEN 9 THEN 'PCM, Arts,' ELSE (o_orderkey % 28 + 1) || '/3/2021' END AS value,
 CASE WHEN o_orderkey % 2 = 0 THEN 'estimated: by staff' ELSE 'as stated' END AS evidence, o_orderpriority AS source_id, o_orderdate AS observed_at, o_orderkey AS id FROM orders),
pooled AS (SELECT CASE WHEN entity_key LIKE 'cisce:%' AND (split_part(entity_key, ':', 2)::INT - 1) % 20 = 0 THEN 'cbse:' || (split_part(entity_key, ':', 2)::INT - 1) ELSE entity_key END AS entity_key, entity_key AS own_key, field, value, evidence, source_id, observed_at, id FROM log),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key, field ORDER BY source_id, observed_at DESC, id) AS rk FROM pooled WHERE source_id IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) WHERE rk = 1),
wide AS (SELECT entity_key, max(value) FILTER (field = 'name') AS name, max(value) FILTER (field = 'city') AS city, max(value) FILTER (field = 'district') AS district, max(value) FILTER (field = 'website') AS website,
 max(value) FILTER (field = 'fee_annual_inr') AS fee, max(value) FILTER (field = 'total_enrollment') AS enrollment, max(evidence) FILTER (field = 'total_enrollment') AS ev, max(value) FILTER (field = 'has_class_12') AS c12, max(value) FILTER (field = 'status') AS status,
 max(value) FILTER (field = 'principal_name') AS principal, max(value) FILTER (field = 'streams') AS streams, max(value) FILTER (field = 'board_valid_from') AS valid_from FROM won GROUP BY entity_key),
canon AS (SELECT * FROM wide WHERE name IS NOT NULL AND entity_key NOT LIKE 'odd:%')"""


def claim_log(t) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda *x: F.element_at(F.array(*x), (k % 11 + 1).cast("int"))
    s = lambda x: x.cast("string")
    value = pick(
        F.concat(F.lit("Name "), s(k)), F.lit("Poona"), F.lit("Bellary"), F.concat(F.lit("https://www.s"), s(k % 90), F.lit(".in/x")), F.concat(s(k % 90), F.lit(",500.7")), s(k % 900), F.when(k % 2 == 0, "Yes").otherwise("no"),
        F.when(k % 3 == 0, "disaffiliated").otherwise("active"), F.concat(F.when(k % 2 == 0, "Dr. ").otherwise(""), F.lit("P "), s(k % 70)), F.lit("PCM, Arts,"), F.concat(s(k % 28 + 1), F.lit("/3/2021")),
    )
    c = F.col("o_custkey")
    key = F.concat(F.when(c % 4 == 0, "cbse:").when(c % 4 == 1, "cisce:").when(c % 4 == 2, "udise:").otherwise("odd:"), s(c % 400))
    evidence = F.when(k % 2 == 0, "estimated: by staff").otherwise("as stated")
    return t("orders").select(key.alias("entity_key"), pick(*map(F.lit, FIELDS)).alias("field"), value.alias("value"), evidence.alias("evidence"), F.col("o_orderpriority").alias("source_id"), F.col("o_orderdate").alias("observed_at"), k.alias("id"))


def merges(t) -> DataFrame:
    """(key, primary) of the decisions that join a key of one registry with the next number of another."""
    same = t("orders").select((F.col("o_custkey") % 400).alias("n")).distinct().where("n % 20 = 0")
    return merge_components(same.select(F.concat(F.lit("cbse:"), F.col("n").cast("string")).alias("a"), F.concat(F.lit("cisce:"), (F.col("n") + 1).cast("string")).alias("b")), "a", "b")


def winners(t) -> DataFrame:
    ranked = C.resolve(B.pool(B.checked(claim_log(t), FIELDS), merges(t)), {f: list(SOURCES) for f in FIELDS})
    return ranked.where("won").select("entity_key", "field", "value", "evidence")


@query(f"""WITH {LOG_SQL} SELECT entity_key, name AS canonical_name, lower(c12) = 'yes' AS has_class_12, coalesce(status, 'active') AS status, enrollment::BIGINT AS total_enrollment, floor(replace(fee, ',', '')::DOUBLE)::BIGINT AS fee_annual_inr_min,
 floor(replace(fee, ',', '')::DOUBLE)::BIGINT AS fee_annual_inr_max, coalesce(enrollment IS NOT NULL AND contains(ev, 'estimated:'), false) AS enrollment_is_estimated, CASE WHEN streams IS NOT NULL THEN 'PCM+Arts' END AS streams,
 CASE WHEN city IS NOT NULL THEN 'pune' WHEN district IS NOT NULL THEN 'ballari' END AS city, CASE WHEN district IS NOT NULL THEN 'ballari' END AS district, regexp_extract(website, 'www\\.([^/]*)', 1) AS website FROM canon""")
def canonical_build(t):
    rows = B.canonical(winners(t), FIELDS)
    return rows.select("entity_key", "canonical_name", "has_class_12", "status", "total_enrollment", "fee_annual_inr_min", "fee_annual_inr_max", "enrollment_is_estimated", F.array_join("streams", "+").alias("streams"), "city", "district", "website")


@query(f"""WITH {LOG_SQL} SELECT entity_key, CASE split_part(entity_key, ':', 1) WHEN 'cbse' THEN 'CBSE' ELSE 'CISCE_ISC' END AS board, CASE WHEN status = 'disaffiliated' THEN 'expired' ELSE 'active' END AS status,
 strptime(valid_from, '%d/%m/%Y')::DATE::VARCHAR AS valid_from FROM canon WHERE entity_key NOT LIKE 'udise:%'""")
def canonical_boards(t):
    return B.boards(B.canonical(winners(t), FIELDS)).select("entity_key", "board", "status", F.col("valid_from").cast("string").alias("valid_from"))


@query(f"WITH {LOG_SQL} SELECT entity_key, principal AS full_name, lower(replace(principal, 'Dr. ', '')) AS normalized_name, 'Principal' AS title_raw, 'principal' AS title FROM canon WHERE principal IS NOT NULL")
def canonical_roles(t):
    return B.roles(B.canonical(winners(t), FIELDS))


@query(f"""WITH {LOG_SQL}, old AS (SELECT entity_key, row_number() OVER (ORDER BY entity_key) * 3 AS id FROM canon WHERE entity_key LIKE 'cbse:%')
SELECT (SELECT count(*) FROM canon) AS n_rows, (SELECT count(*) FROM canon) AS ids, (SELECT count(*) FROM old) AS kept, (SELECT max(id) FROM old) + (SELECT count(*) FROM canon WHERE entity_key NOT LIKE 'cbse:%') AS largest""")
def canonical_ids(t):
    rows = B.canonical(winners(t), FIELDS).select("entity_key")
    given = B.with_ids(rows.where("entity_key LIKE 'cbse:%'"), rows.limit(0).withColumn("id", F.lit(0).cast("long"))).withColumn("id", F.col("id") * 3)
    out = B.with_ids(rows, given)
    kept = out.join(given.withColumnRenamed("id", "was"), "entity_key", "left")
    return kept.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("ids"), F.count_if(F.col("id") == F.col("was")).alias("kept"), F.max("id").alias("largest"))


@query(f"WITH {LOG_SQL} SELECT p.id, p.own_key AS entity_key, c.entity_key AS linked FROM pooled p LEFT JOIN canon c ON c.entity_key = p.entity_key")
def claims_linked_back(t):
    rows = B.canonical(winners(t), FIELDS).select("entity_key", F.col("entity_key").alias("id"))
    return B.link_back(claim_log(t), merges(t), rows).select("id", "entity_key", F.col("institution_id").alias("linked"))


SCORED_SQL = """s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey % 1000) / 10.0::DOUBLE END AS fit, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 60 - 30 END AS boost FROM customer),
a AS (SELECT k, coalesce(CASE WHEN fit IS NOT NULL AND coalesce(boost, 0) <> 0 THEN greatest(0.0, least(100.0, fit + boost)) ELSE fit END, 0.0) AS score, fit IS NULL AS insufficient,
 list_filter([CASE WHEN k % 3 = 0 THEN 'fee_unverified' END, CASE WHEN k % 4 = 0 THEN 'pcm_estimated' END, CASE WHEN k % 5 = 0 THEN 'stale_leadership' END, CASE WHEN fit IS NULL THEN 'insufficient_data' END], lambda x: x IS NOT NULL) AS flags FROM s)"""


def _assembled(t) -> DataFrame:
    k = F.col("k")
    rows = t("customer").select(F.col("c_custkey").alias("k"))
    fit, boost = F.when(k % 10 != 0, (k % 1000) / 10.0), F.when(k % 7 == 0, k % 60 - 30)
    return B.assembled(rows, fit, boost, {"fee_unverified": k % 3 == 0, "pcm_estimated": k % 4 == 0, "stale_leadership": k % 5 == 0})


@query(f"WITH {SCORED_SQL} SELECT k, score, insufficient, array_to_string(flags, ';') AS flags FROM a")
def score_assembly(t):
    return _assembled(t).withColumn("flags", F.array_join("flags", ";"))


@query(f"WITH {SCORED_SQL} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM a) GROUP BY flag")
def flag_histogram(t):
    return B.histogram(_assembled(t), "flags")


@query("""WITH o AS (SELECT o_custkey AS k, 'm' || (o_orderkey % 3) AS model_version, 'c' || (o_orderkey % 2) AS campaign, o_totalprice AS fit FROM orders)
SELECT k, model_version, campaign, fit FROM o WHERE NOT (model_version = 'm1' AND campaign = 'c0') UNION ALL SELECT c_custkey, 'm1', 'c0', c_acctbal FROM customer""")
def scores_replaced(t):
    k = F.col("o_orderkey")
    old = t("orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("model_version"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("campaign"), F.col("o_totalprice").alias("fit"))
    return B.replace_scores(old, t("customer").select(F.col("c_custkey").alias("k"), F.lit("m1").alias("model_version"), F.lit("c0").alias("campaign"), F.col("c_acctbal").alias("fit")))


@query("""SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey % 150 FROM customer) UNION ALL SELECT c_custkey % 150, arg_max(c_name, c_custkey) FROM customer GROUP BY 1""")
def registry_upsert(t):
    old = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    rows = t("customer").select((F.col("c_custkey") % 150).alias("id"), F.col("c_name").alias("name"), "c_custkey")
    return B.upsert(old, rows, ["id"], F.col("c_custkey"))


@query("""WITH d AS (SELECT sha256(text) AS h, doc_id, lang FROM documents), m AS (SELECT DISTINCT h, 1 AS v FROM d WHERE lang = 'en'),
n AS (SELECT DISTINCT h, 1 + (doc_id % 2)::INT AS v FROM d)
SELECT h AS content_hash, v AS version FROM m UNION SELECT h, v FROM n WHERE h IN (SELECT h FROM d WHERE lang IS DISTINCT FROM 'de')""")
def marker_inserts(t):
    d = t("documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id", "lang")
    old = d.where("lang = 'en'").select("content_hash", F.lit(1).alias("version")).distinct()
    done = d.select("content_hash", (F.col("doc_id") % 2 + 1).cast("int").alias("version"))
    return B.add_markers(old, done, d.where("lang IS DISTINCT FROM 'de'"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def pruned_to_seen(t):
    seen = t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return B.prune(t("customer").select("c_custkey"), seen, "c_custkey")


@query("SELECT 'conflict' AS kind, '{\"k\":' || o_orderkey || ',\"source\":\"' || o_orderpriority || '\"}' AS payload, 'open' AS state FROM orders WHERE o_totalprice > 200000")
def review_cases(t):
    rows = t("orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("source"))
    return B.review_rows(rows, "conflict", "k", "source")
