"""The engine's operators on the tables at hand, each with the SQL that states what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.functions import identity as I
from claimspark.functions import text as X
from claimspark.operators import claims as C
from claimspark.operators import score as S
from claimspark.operators.components import merge_components
from claimspark.sources import pages as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


POLICY = {"total": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "qty": ["1-URGENT", "5-LOW"]}
AFFORDABILITY = [(50000, 0), (100000, 6), (150000, 15), (300000, 30), (600000, 28), (1000000, 22), (None, 16)]
METROS = {"000": "Alpha", "0001": "Beta", "00012": "Gamma", "00": "Delta"}
CLAIMS_SQL = """claims AS (SELECT 'c:' || o_custkey AS entity_key, 'total' AS field, o_totalprice AS value, o_orderpriority AS source_id, o_orderdate AS observed_at, o_orderkey AS id FROM orders
 UNION ALL SELECT 'c:' || o_custkey, 'qty', length(o_orderstatus) * 1.0 + o_orderkey % 7, o_orderpriority, o_orderdate, o_orderkey FROM orders),
policy(field, source_id, place) AS (VALUES ('total', '1-URGENT', 0), ('total', '2-HIGH', 1), ('total', '3-MEDIUM', 2), ('qty', '1-URGENT', 0), ('qty', '5-LOW', 1)),
ranked AS (SELECT c.*, place, row_number() OVER (PARTITION BY c.entity_key, c.field ORDER BY place NULLS LAST, observed_at DESC, id) AS rk, min(place) OVER (PARTITION BY c.entity_key, c.field) AS top
 FROM claims c LEFT JOIN policy p ON c.field = p.field AND c.source_id = p.source_id)"""


def claim_log(t) -> DataFrame:
    o = t("orders")
    base = [F.concat(F.lit("c:"), F.col("o_custkey")).alias("entity_key")]
    rest = [F.col("o_orderpriority").alias("source_id"), F.col("o_orderdate").alias("observed_at"), F.col("o_orderkey").alias("id")]
    qty = F.length("o_orderstatus") * F.lit(1.0) + F.col("o_orderkey") % 7
    return o.select(*base, F.lit("total").alias("field"), F.col("o_totalprice").alias("value"), *rest).unionByName(o.select(*base, F.lit("qty").alias("field"), qty.alias("value"), *rest))


@query(f"WITH {CLAIMS_SQL} SELECT entity_key, field, source_id, value, id FROM ranked WHERE rk = 1 AND place IS NOT NULL")
def conflict_resolve(t):
    return C.resolve(claim_log(t), POLICY).where("won").select("entity_key", "field", "source_id", "value", "id")


@query(f"WITH {CLAIMS_SQL} SELECT entity_key, field, id, CASE WHEN place IS NULL THEN 'source not permitted' WHEN place > top THEN 'lower priority source' ELSE 'older observation' END AS reason FROM ranked WHERE NOT (rk = 1 AND place IS NOT NULL)")
def conflict_losers(t):
    return C.resolve(claim_log(t), POLICY).where("NOT won").select("entity_key", "field", "id", "reason")


@query(f"WITH {CLAIMS_SQL} SELECT r.entity_key, r.field, bool_or(coalesce(r.source_id <> w.source_id AND r.place IS NOT NULL AND w.value <> 0 AND abs(r.value - w.value) > 0.2 * abs(w.value), false)) AS disputed FROM ranked r JOIN ranked w ON r.entity_key = w.entity_key AND r.field = w.field AND w.rk = 1 AND w.place IS NOT NULL GROUP BY ALL")
def conflict_disputes(t):
    return C.disputes(C.resolve(claim_log(t), POLICY), fields=list(POLICY))


@query(f"WITH {CLAIMS_SQL} SELECT entity_key, max(value) FILTER (field = 'total') AS total, max(value) FILTER (field = 'qty') AS qty FROM ranked WHERE rk = 1 AND place IS NOT NULL GROUP BY entity_key")
def canonical_pivot(t):
    return C.pivot_winners(C.resolve(claim_log(t), POLICY), ["total", "qty"])


@query("SELECT n_name AS state, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS enriched FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def state_summary(t):
    seen = t("orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("seen", F.lit(True))
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(seen, F.col("c_custkey") == F.col("k"), "left")
    return rows.groupBy(F.col("n_name").alias("state")).agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.count_if("seen").alias("enriched"))


@query("SELECT count(*) AS institutions, count(DISTINCT c_nationkey) AS states, count(*) FILTER (c_acctbal IS NOT NULL) AS with_balance, count(*) FILTER (c_mktsegment = 'BUILDING') AS building FROM customer")
def coverage_totals(t):
    return t("customer").agg(F.count("*").alias("institutions"), F.countDistinct("c_nationkey").alias("states"), F.count("c_acctbal").alias("with_balance"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"))


@query("SELECT c_nationkey, c_custkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer WHERE c_acctbal > 0) WHERE rn <= 3")
def per_state_topn(t):
    rn = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return t("customer").where("c_acctbal > 0").withColumn("rn", rn).where("rn <= 3").select("c_nationkey", "c_custkey", "rn")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS campuses, min(c_name) AS name FROM customer GROUP BY ALL HAVING count(*) >= 2")
def group_detect(t):
    return t("customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("campuses"), F.min("c_name").alias("name")).where("campuses >= 2")


@query("SELECT c_mktsegment, count(*) AS campuses, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS states, (SELECT n_name FROM customer c JOIN nation ON c_nationkey = n_nationkey WHERE c.c_mktsegment = o.c_mktsegment GROUP BY n_name ORDER BY count(*) DESC, n_name LIMIT 1) AS hq FROM customer o JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment")
def group_rollup(t):
    per = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))
    return per.groupBy("c_mktsegment").agg(F.sum("n").alias("campuses"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("states"), F.min_by("n_name", F.struct(-F.col("n"), "n_name")).alias("hq"))


@query("SELECT c_mktsegment, count(*) FILTER (c_acctbal >= 5000 OR (c_acctbal < 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'))) AS qualifying FROM customer GROUP BY c_mktsegment")
def qualifying_rollup(t):
    tier = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct().withColumn("tier", F.lit(True))
    ok = (F.col("c_acctbal") >= 5000) | ((F.col("c_acctbal") < 0) & F.coalesce("tier", F.lit(False)))
    return t("customer").join(tier, F.col("c_custkey") == F.col("k"), "left").groupBy("c_mktsegment").agg(F.count_if(ok).alias("qualifying"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) ON o_custkey = c_custkey AND rn = 1")
def latest_row_lateral(t):
    last = C.latest(t("orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), "o_orderkey", "o_totalprice")
    return t("customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_role, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS boards FROM orders GROUP BY o_custkey")
def first_role_and_boards(t):
    return t("orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_role"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ", ").alias("boards"))


@query("SELECT l_orderkey, l_returnflag, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_discount DESC, l_shipdate DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def distinct_on_best(t):
    order = [F.desc("l_discount"), F.desc("l_shipdate"), "l_linenumber", F.desc("l_extendedprice")]  # the price last, so that a tie of the SQL's order has one answer
    rn = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy(*order))
    return t("lineitem").withColumn("rn", rn).where("rn = 1").select("l_orderkey", "l_returnflag", "l_linenumber", "l_extendedprice")


@query("""WITH s AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS site FROM pages), hit AS (SELECT page_id, site, count(*) OVER (PARTITION BY page_id) AS n FROM pages JOIN s ON contains(lower(url), lower(site)))
SELECT page_id, site FROM hit WHERE n = 1""")
def unique_attribution(t):
    sites = t("pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("site")).distinct()
    return C.attributed_once(t("pages"), sites, "page_id", "url", "site")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1)")
def not_in_anti(t):
    mixed = t("orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n")).where("n > 1")
    return t("customer").join(mixed, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def not_exists_anti(t):
    return t("orders").join(t("lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query()  # recursive SQL is too slow for all orders, so a union-find in the tests holds it
def merge_decisions_all(t):
    return merge_components(t("orders").selectExpr("o_custkey AS a", "o_custkey + 1 + o_orderkey % 3 AS b"), "a", "b")


@query("WITH v(id, entity, field, value, expired) AS (VALUES (1, 5, 'c_mktsegment', 'X', false), (2, 5, 'c_mktsegment', 'Y', false), (3, 7, 'c_name', 'Z', true), (4, 9, 'c_name', 'N', false)) SELECT c_custkey, coalesce((SELECT arg_max(value, id) FROM v WHERE entity = c_custkey AND field = 'c_name' AND NOT expired), c_name) AS c_name, coalesce((SELECT arg_max(value, id) FROM v WHERE entity = c_custkey AND field = 'c_mktsegment' AND NOT expired), c_mktsegment) AS c_mktsegment FROM customer")
def overrides_last(t):
    rows = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    given = rows.sparkSession.createDataFrame([(1, 5, "c_mktsegment", "X", False), (2, 5, "c_mktsegment", "Y", False), (3, 7, "c_name", "Z", True), (4, 9, "c_name", "N", False)], "id int, entity long, field string, value string, expired boolean")
    return C.apply_overrides(rows, given, "c_custkey", ["c_name", "c_mktsegment"])


@query("SELECT c_custkey, coalesce(" + ", ".join(f"CASE substr(lpad(c_custkey::VARCHAR, 6, '0'), 1, {n}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METROS.items() if len(k) == n) + " END" for n in (5, 4, 3, 2)) + ") AS metro FROM customer")
def longest_prefix(t):
    return t("customer").select("c_custkey", X.longest_prefix(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), METROS).alias("metro"))


@query("SELECT p_partkey, coalesce((p_size + p_partkey % 9) // 2, p_size) AS mid, CASE WHEN p_retailprice * 100 < 50000 THEN 0 WHEN p_retailprice * 100 < 100000 THEN 6 WHEN p_retailprice * 100 < 150000 THEN 15 WHEN p_retailprice * 100 < 300000 THEN 30 WHEN p_retailprice * 100 < 600000 THEN 28 WHEN p_retailprice * 100 < 1000000 THEN 22 ELSE 16 END AS points FROM part")
def fee_mid_and_bands(t):
    return t("part").select("p_partkey", F.expr("coalesce((p_size + p_partkey % 9) div 2, p_size)").alias("mid"), X.band(F.col("p_retailprice") * 100, AFFORDABILITY).alias("points"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'verified' WHEN c_acctbal > 0 THEN 'weak' ELSE 'none' END AS tier FROM customer WHERE c_acctbal > 0 AND lower(c_mktsegment) = 'building' ORDER BY c_acctbal DESC, c_custkey LIMIT 200")
def contact_filter_ranked(t):
    tier = F.when(F.col("c_acctbal") > 5000, "verified").when(F.col("c_acctbal") > 0, "weak").otherwise("none")
    rows = t("customer").where((F.col("c_acctbal") > 0) & (F.lower("c_mktsegment") == "building"))
    return rows.orderBy(F.desc("c_acctbal"), "c_custkey").limit(200).select("c_custkey", tier.alias("tier"))


@query("SELECT p_partkey FROM part WHERE list_has_all(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), ['red', 'widget'])")
def fts_and(t):
    return t("part").where(X.has_all_words(X.tokens(F.col("p_name")), "red widget")).select("p_partkey")


@query("WITH g AS (SELECT c_custkey, list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM customer), q AS (SELECT g AS qg FROM g WHERE c_custkey = (SELECT min(c_custkey) FROM customer)) SELECT c_custkey, len(list_intersect(g, qg)) AS common FROM g, q WHERE len(list_intersect(g, qg))::DOUBLE / len(list_distinct(list_concat(g, qg))) >= 0.3")
def trigram_search(t):
    c = t("customer")
    name = c.orderBy("c_custkey").select("c_name").first()[0]
    both = F.size(F.array_intersect(X.trigrams(F.col("c_name")), X.trigrams(F.lit(name))))
    return c.where(X.similarity(F.col("c_name"), F.lit(name)) >= 0.3).select("c_custkey", both.alias("common"))


@query("SELECT n_name AS place FROM nation UNION SELECT r_name FROM region")
def known_places_union(t):
    return t("nation").select(F.col("n_name").alias("place")).union(t("region").select("r_name")).distinct()


@query("SELECT page_id, CASE WHEN contains(h, '.') AND NOT contains(h, '..') THEN h END AS domain FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^www\\.', '') AS h FROM pages)")
def url_domain(t):
    return t("pages").select("page_id", X.normalize_domain(F.col("url")).alias("domain"))


def _deny_sql() -> str:
    return "SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(url, '(?i){p}') THEN '{p}'" for p in X.URL_DENY_PATTERNS) + " END AS pattern FROM pages"


@query(_deny_sql())
def denylist(t):
    # the whole url and nothing else: patterns are never to run over page text
    return t("pages").select("page_id", X.denied_by(F.col("url")).alias("pattern"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_seen, count(*) AS copies FROM documents GROUP BY 1")
def content_dedupe(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("copies"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}'))), ',') AS emails FROM documents")
def emails(t):
    return t("documents").select("doc_id", F.array_join(F.array_sort(X.emails(F.col("text"))), ",").alias("emails"))


@query(r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\+?91[\s-]?)?\d[\d\s()-]{7,14}\d')) AS raw FROM documents),
d AS (SELECT doc_id, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM c), e AS (SELECT doc_id, CASE WHEN starts_with(d, '910') THEN substr(d, 4) ELSE d END AS d FROM d),
f AS (SELECT doc_id, ltrim(CASE WHEN starts_with(d, '91') AND length(d) > 10 THEN substr(d, 3) ELSE d END, '0') AS d FROM e),
g AS (SELECT doc_id, string_agg(DISTINCT right(d, 10), ',' ORDER BY right(d, 10)) AS phones FROM f WHERE length(d) IN (10, 11) GROUP BY doc_id)
SELECT doc_id, coalesce(phones, '') AS phones FROM documents LEFT JOIN g USING (doc_id)""")
def phones(t):
    return t("documents").select("doc_id", F.array_join(F.array_sort(X.normalize_phones(F.col("text"))), ",").alias("phones"))


@query("WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isle FROM events), r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isle ORDER BY ts, event_id) AS run FROM g) SELECT user_id, event_id, run FROM r WHERE event_type = 'error' AND run >= 2")
def circuit_breaker(t):
    return C.breaker_opens(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2).select("user_id", "event_id", F.col("run").cast("decimal(38,0)").cast("long").alias("run"))


@query("SELECT doc_id, text FROM (SELECT doc_id, sha256(text) AS h, lang AS text, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) d WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM labels l JOIN documents x USING (doc_id) WHERE sha256(x.text) = d.h)")
def incremental_markers(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"), F.col("lang").alias("text"))
    first = C.latest(d, ["h"], -F.col("doc_id"), "doc_id", "text")
    return first.join(d.join(t("labels"), "doc_id").select("h"), "h", "left_anti").select("doc_id", "text")


@query("WITH p AS (SELECT l.doc_id, toxic, (text LIKE '%idiot%')::INT AS guess FROM labels l JOIN documents USING (doc_id)) SELECT count(*) AS gold, sum(guess) AS produced, sum(guess * toxic) AS correct, round(sum(guess * toxic)::DOUBLE / nullif(sum(guess), 0), 3) AS prec, round(sum(guess * toxic)::DOUBLE / nullif(sum(toxic), 0), 3) AS recall FROM p")
def eval_precision_recall(t):
    p = t("labels").join(t("documents"), "doc_id").select("toxic", F.contains("text", F.lit("idiot")).cast("int").alias("guess"))
    s = p.agg(F.count("*").alias("gold"), F.sum("guess").alias("produced"), F.sum(F.col("guess") * F.col("toxic")).alias("correct"), F.sum("toxic").alias("positive"))
    return s.select("gold", "produced", "correct", F.round(F.try_divide("correct", "produced"), 3).alias("prec"), F.round(F.try_divide("correct", "positive"), 3).alias("recall"))


@query("WITH k AS (SELECT page_id, regexp_extract(url, '://(?:www\\.|m\\.|blog\\.)?([^./]+)', 1) AS token FROM pages), n AS (SELECT *, count(*) OVER (PARTITION BY token) AS n FROM k) SELECT page_id, token || '@gmail.com' AS guess FROM n WHERE n <= 3")
def guess_token_guard(t):
    k = t("pages").select("page_id", F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^./]+)", 1).alias("token"))
    rare = k.groupBy("token").agg(F.count("*").alias("n")).where("n <= 3")
    return k.join(rare, "token").select("page_id", F.concat("token", F.lit("@gmail.com")).alias("guess"))


@query("SELECT o_orderpriority, round_even(avg(o_orderkey % 1000), 0)::BIGINT AS mean, round_even(median(o_orderkey % 1000), 0)::BIGINT AS med FROM orders GROUP BY 1")
def population_stats(t):
    v = F.col("o_orderkey") % 1000
    return t("orders").groupBy("o_orderpriority").agg(F.bround(F.avg(v)).cast("long").alias("mean"), F.bround(F.median(v)).cast("long").alias("med"))


@query("""WITH j AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END AS state, event_id % 5 + 1 AS attempts, ts, TIMESTAMP '2024-01-15 00:00:00' AS now FROM events),
k AS (SELECT *, state = 'failed' AND attempts < 4 AS again, state = 'running' AND ts < now - INTERVAL 30 MINUTES AS stale FROM j)
SELECT event_id, CASE WHEN state = 'failed' AND attempts >= 4 THEN 'dead' WHEN again OR stale THEN 'pending' ELSE state END AS state, CASE WHEN again THEN CASE attempts WHEN 1 THEN 2 WHEN 2 THEN 8 ELSE 30 END ELSE 0 END AS wait_s,
 CASE WHEN again THEN now + INTERVAL 1 SECOND * (CASE attempts WHEN 1 THEN 2 WHEN 2 THEN 8 ELSE 30 END) ELSE ts END AS not_before, CASE WHEN state = 'running' AND NOT stale THEN 'w' END AS locked_by FROM k""")
def queue_backoff(t):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise("pending")
    lock = F.when(state != "pending", "w")
    jobs = t("events").select("event_id", state.alias("state"), (F.col("event_id") % 5 + 1).alias("attempts"), F.lit(4).alias("max_attempts"), F.col("ts").alias("not_before"), lock.alias("locked_by"), F.col("ts").alias("locked_at"))
    return C.queue_step(jobs, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", "state", "wait_s", "not_before", "locked_by")


@query("WITH d AS (SELECT user_id % 50 AS scope, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, lag(n) OVER (PARTITION BY scope ORDER BY day) AS prev FROM d) SELECT scope, day::VARCHAR AS day, n FROM p WHERE n < 0.5 * prev")
def drift_guard(t):
    d = t("events").groupBy((F.col("user_id") % 50).alias("scope"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    prev = F.lag("n").over(Window.partitionBy("scope").orderBy("day"))
    return d.withColumn("prev", prev).where("n < 0.5 * prev").select("scope", F.col("day").cast("string").alias("day"), "n")


@query("SELECT c_name AS Name, coalesce(n_name, '') AS State, coalesce(c_mktsegment, '') AS Segment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY c_custkey LIMIT 5000")
def export_projection(t):
    rows = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").orderBy("c_custkey").limit(5000)
    return rows.select(F.col("c_name").alias("Name"), F.coalesce("n_name", F.lit("")).alias("State"), F.coalesce("c_mktsegment", F.lit("")).alias("Segment"))


INSTITUTIONS_SQL = """inst AS (SELECT c_custkey AS k, c_nationkey AS nk, n, fee, oldest, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
 LEFT JOIN (SELECT o_custkey, count(*) AS n, max(floor(o_totalprice))::BIGINT AS fee, min(o_orderdate) AS oldest FROM orders GROUP BY 1) ON o_custkey = c_custkey),
tiers AS (SELECT o_custkey, sum(p) AS points, count(*) AS m FROM (SELECT DISTINCT o_custkey, o_orderpriority, CASE left(o_orderpriority, 1) WHEN '1' THEN 20 WHEN '2' THEN 16 WHEN '3' THEN 11 WHEN '4' THEN 4 ELSE 0 END AS p FROM orders) GROUP BY 1),
board AS (SELECT o_custkey, max(CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 12 ELSE 5 END) AS tier FROM orders GROUP BY 1)"""


def institutions(t) -> DataFrame:
    """Customers as institutions: k, nk, n, fee, oldest, n_name, boards, tiers; one aggregation of the orders."""
    board = F.when(F.col("o_orderstatus") == "F", "CBSE").when(F.col("o_orderstatus") == "O", "CISCE_ISC").otherwise("STATE_X")
    o = t("orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.max(F.floor("o_totalprice")).cast("long").alias("fee"), F.min("o_orderdate").alias("oldest"),
        F.collect_set(board).alias("boards"), F.collect_set(F.substring("o_orderpriority", 1, 1).cast("int")).alias("tiers"),
    )
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"), "n", "fee", "oldest", "n_name", "boards", "tiers")


@query(f"""WITH {INSTITUTIONS_SQL},
h AS (SELECT *, CASE WHEN k % 3 = 0 THEN n * 20 END AS pcm, CASE WHEN k % 3 = 0 THEN n * 20 WHEN k % 3 = 1 THEN round_even(n * 37 * 0.45::DOUBLE, 0)::BIGINT WHEN k % 2 = 0 THEN round_even(n * 211 * 0.06::DOUBLE, 0)::BIGINT END AS head FROM inst),
p AS (SELECT k, 10 * CASE WHEN fee < 50000 THEN 0 WHEN fee < 100000 THEN 6 WHEN fee < 150000 THEN 15 WHEN fee < 300000 THEN 30 WHEN fee < 600000 THEN 28 WHEN fee < 1000000 THEN 22 WHEN fee >= 1000000 THEN 16 END AS a,
 CASE WHEN pcm IS NULL THEN 6 ELSE 10 END * CASE WHEN head >= 300 THEN 25 WHEN head >= 200 THEN 22 WHEN head >= 120 THEN 18 WHEN head >= 60 THEN 12 WHEN head >= 25 THEN 6 WHEN head >= 0 THEN 2 END AS b, 10 * tier AS c,
 10 * CASE WHEN k % 50 = 0 THEN 15 WHEN nk = 0 THEN 11 WHEN nk = 1 THEN 8 WHEN nk = 2 THEN 12 WHEN nk <> 3 THEN 3 END AS d,
 10 * nullif((k % 7 = 0)::INT * 4 + (k % 4 = 0)::INT * 3 + (k % 2 = 0)::INT * 2 + (k % 3 = 0)::INT, 0) AS e,
 10 * CASE WHEN k % 6 <> 0 THEN 0 ELSE least(CASE WHEN k % 30 >= 20 THEN 5 WHEN k % 30 >= 5 THEN 3 WHEN k % 30 >= 2 THEN 1 ELSE 0 END, CASE WHEN k % 12 = 0 THEN 1 ELSE 5 END) END AS f FROM h LEFT JOIN board ON o_custkey = k),
s AS (SELECT k, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0) + coalesce(e, 0) + f AS got, (a IS NOT NULL)::INT * 30 + (b IS NOT NULL)::INT * 25 + (c IS NOT NULL)::INT * 15 + (d IS NOT NULL)::INT * 15 + (e IS NOT NULL)::INT * 10 + 5 AS possible FROM p)
SELECT k, got / 10.0::DOUBLE AS earned, possible, CASE WHEN possible >= 40 THEN round_even(10 * got / possible::DOUBLE, 1) END AS fit FROM s""")
def fit_score(t):
    k, nk, n = F.col("k"), F.col("nk"), F.col("n")
    head = S.headcount(F.when(k % 3 == 0, n * 20), F.when(k % 3 == 1, n * 37), n * 211, F.when(k % 2 == 1, 6))
    parts = S.components(
        fee=F.col("fee"), head=F.col("head"), boards=F.col("boards"), district=F.when(k % 50 == 0, "Bengaluru Urban"),
        metro=F.when(nk == 0, "Pune").when(nk == 1, "Kochi"), state=F.when(nk == 2, "Karnataka").when(nk != 3, F.col("n_name")),
        counsellor=k % 7 == 0, principal_fresh=k % 4 == 0, email=k % 2 == 0, phone=k % 3 == 0, campuses=F.when(k % 6 == 0, k % 30), franchise=k % 12 == 0,
    )
    return institutions(t).withColumn("head", head).select("k", S.fit(parts).alias("s")).select("k", "s.*")


@query(f"""WITH {INSTITUTIONS_SQL} SELECT k, round_even(least(60.0::DOUBLE * ((n IS NOT NULL)::INT * 2 + (k % 3 = 0)::INT + (k % 2 = 0)::INT + (k % 7 = 0)::INT + (k % 2 = 0 OR k % 3 = 0)::INT + (k % 5 = 0)::INT + (k % 4 = 0)::INT) / 8
 + coalesce(least(points / m::DOUBLE, 20.0), 0) + CASE WHEN mo IS NULL THEN 0 WHEN mo <= 6 THEN 20 WHEN mo <= 12 THEN 12 WHEN mo <= 24 THEN 6 ELSE 0 END, 100), 1) AS confidence
FROM (SELECT *, date_sub('day', oldest::TIMESTAMP, TIMESTAMP '1996-06-30 12:00:00') / 30.44::DOUBLE AS mo FROM inst) LEFT JOIN tiers ON o_custkey = k""")
def confidence(t):
    k, there = F.col("k"), F.col("n").isNotNull()
    present = [there, there, k % 3 == 0, k % 2 == 0, k % 7 == 0, (k % 2 == 0) | (k % 3 == 0), k % 5 == 0, k % 4 == 0]
    now = F.lit("1996-06-30 12:00:00").cast("timestamp_ntz")
    return institutions(t).select("k", S.confidence(present, F.coalesce("tiers", F.array().cast("array<int>")), F.col("oldest").cast("timestamp_ntz"), now).alias("confidence"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'no class 12' WHEN c_acctbal < 0 THEN 'not active' WHEN c_custkey % 11 = 0 THEN 'excluded' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'no science stream' END AS reason FROM customer")
def hard_gate(t):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    streams = F.when(seg == "BUILDING", F.array(F.lit("Arts"), F.lit("PCM"))).when(seg != "MACHINERY", F.array(F.lit("Commerce")))
    status = F.when(F.col("c_acctbal") < 0, "closed").otherwise("active")
    return t("customer").select(k.alias("k"), S.gate_reason(F.when(k % 7 != 0, k % 5 != 0), status, F.when(k % 11 == 0, True), streams).alias("reason"))


FEE_SQL = "CASE o_orderkey % 7 WHEN 0 THEN 'Rs ' || n || ' per month' WHEN 1 THEN 'INR ' || n || '/- p.a.' WHEN 2 THEN n || ' quarterly' WHEN 3 THEN n || ' per term' WHEN 4 THEN 'fee ' || n WHEN 5 THEN (n % 7) || '.5 Lakhs a year' ELSE n || ' / month, ' || n || ' yearly' END"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 9000 AS n FROM orders), f AS (SELECT o_orderkey, n, {FEE_SQL} AS fee FROM o),
r AS (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN n * 12 WHEN 1 THEN n WHEN 2 THEN n * 4 WHEN 5 THEN (n % 7) * 100000 + 50000 END AS rupees, CASE o_orderkey % 7 WHEN 0 THEN n * 12 WHEN 1 THEN n WHEN 2 THEN n * 4 WHEN 4 THEN n WHEN 5 THEN (n % 7) * 100000 + 50000 END AS assumed FROM f)
SELECT o_orderkey, fee, CASE WHEN rupees BETWEEN 1000 AND 5000000 THEN rupees END AS rupees, CASE WHEN assumed BETWEEN 1000 AND 5000000 THEN assumed END AS assumed FROM r""")
def parse_inr(t):
    rows = t("orders").select("o_orderkey", (F.col("o_orderkey") % 9000).alias("n")).select("o_orderkey", F.expr(FEE_SQL).alias("fee"))
    return rows.select("o_orderkey", "fee", X.parse_inr(F.col("fee")).alias("rupees"), X.parse_inr(F.col("fee"), assume_annual=True).alias("assumed"))


NAMED_SQL = "CASE p_partkey % 4 WHEN 0 THEN 'DPS ' || p_name WHEN 1 THEN p_name || ' Academy, Poona' WHEN 2 THEN 'St. ' || p_name ELSE 'The ' || p_name || ' College' END"


@query(f"""WITH n AS (SELECT p_partkey, p_name, {NAMED_SQL} AS name FROM part)
SELECT p_partkey, name, array_to_string(list_sort(list_concat(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g')), ' '), CASE p_partkey % 4 WHEN 0 THEN ['delhi'] WHEN 1 THEN ['pune'] WHEN 2 THEN ['saint'] ELSE [] END)), ' ') AS key FROM n""")
def match_key(t):
    return t("part").select("p_partkey", F.expr(NAMED_SQL).alias("name")).select("p_partkey", "name", X.match_key(F.col("name")).alias("key"))


def _any_sql(column: str, words: list[str]) -> str:
    return " OR ".join(f"contains({column}, '{w}')" for w in words)


@query("""WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS l FROM pages)
SELECT page_id, CASE WHEN len(l) < 2 THEN l[1] WHEN len(l) >= 3 AND l[-2] IN ('co', 'ac', 'edu', 'gov', 'net', 'org', 'res', 'nic', 'com') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM h""")
def registrable_domain(t):
    return t("pages").select("page_id", I.registrable_domain(F.col("url")).alias("domain"))


@query(f"""WITH b AS (SELECT page_id, coalesce(substr(html, 1, 4096), '') AS head, html FROM pages)
SELECT page_id, {_any_sql("head", P.INTERSTITIAL_MARKERS)} AS interstitial, {" + ".join(f"coalesce(regexp_matches(html, '(?i){m}'), false)::int" for m in P.PAGE_MARKERS)} >= 2 AS disclosure,
 regexp_matches(html, '(?i){P.LOGIN_WALL}') AND NOT ({" + ".join(f"coalesce(regexp_matches(html, '(?i){m}'), false)::int" for m in P.PAGE_MARKERS)} >= 2) AS login_wall FROM b""")
def page_classes(t):
    h = F.col("html")
    return t("pages").select("page_id", P.is_interstitial(h).alias("interstitial"), P.is_disclosure_page(h).alias("disclosure"), P.is_login_wall(h).alias("login_wall"))


@query()
def html_links(t):
    return P.html_links(t("pages"), "page_id", "html", "url").select("page_id", "url", "label")


@query()
def html_tables(t):
    return P.html_tables(t("pages"), "page_id", "html")


@query("""WITH n AS (SELECT c_custkey, ['dr', 'mrs', 'fr'][c_custkey % 3 + 1] || '. ' || c_name AS raw FROM customer)
SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9_]+', ' ', 'g')) AS person, CASE WHEN c_custkey % 3 = 0 THEN 'vice_principal' WHEN c_custkey % 3 = 1 THEN 'trustee' ELSE 'other' END AS title FROM n JOIN customer USING (c_custkey)""")
def persons_and_titles(t):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("c_custkey") % 3 + 1).cast("int"))
    return t("customer").select("c_custkey", I.normalize_person(F.concat(pick("Dr", "Mrs", "Fr"), F.lit(". "), "c_name")).alias("person"), I.normalize_title(pick("Vice-Principal (Sr)", "Hon. Secretary", "Peon")).alias("title"))


@query("""WITH o AS (SELECT o_orderkey, 2000 + o_orderkey % 30 AS y, o_totalprice AS e, o_totalprice * (1 + (o_orderkey % 3) * 0.04) AS a FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN y END::int AS fee_year, coalesce(CASE WHEN e = 0 THEN a = 0 ELSE abs(a - e) / abs(e) <= 0.05 END, false) AS agrees FROM o""")
def fee_years_and_agreement(t):
    y = 2000 + F.col("o_orderkey") % 30
    said = F.concat(F.lit("SESSION"), y, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-"), y + 1)).otherwise(F.lit(" only")))
    off = F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 3) * F.lit(0.04).cast("double"))
    return t("orders").select("o_orderkey", I.fee_year(said).alias("fee_year"), I.values_agree(F.col("o_totalprice"), off, 0.05).alias("agrees"))


@query("""WITH s AS (SELECT c_nationkey AS k, count(*) AS total FROM customer GROUP BY 1), m AS (SELECT max(total) AS largest FROM s)
SELECT n_name, total, CASE WHEN n_nationkey % 5 > 0 THEN round_even((70.0::double + n_nationkey - 68) / 29.5 * 760, 1) END AS x, CASE WHEN n_nationkey % 5 > 0 THEN round_even((37.5::double - 8 - n_nationkey) / 31.5 * 820, 1) END AS y, round_even(6 + 34 * sqrt(total / largest), 1) AS radius
FROM nation JOIN s ON k = n_nationkey CROSS JOIN m""")
def map_points(t):
    per = t("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("total"))
    per = per.withColumn("largest", F.max("total").over(Window.partitionBy()))  # one row for each state
    where = t("nation").where("n_nationkey % 5 > 0").select(F.col("n_nationkey").alias("k"), I.map_point(8 + F.col("n_nationkey").cast("double"), 70 + F.col("n_nationkey").cast("double")).alias("at"))
    rows = t("nation").join(per, F.col("n_nationkey") == F.col("c_nationkey")).join(where, F.col("n_nationkey") == F.col("k"), "left")
    return rows.select("n_name", "total", "at.x", "at.y", I.bubble_radius(F.col("total"), F.col("largest")).alias("radius"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims resolved to canonical rows, scored by bands, the best three of each state."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = C.pivot_winners(C.resolve(claim_log(t), POLICY), ["total", "qty"]).withColumn("k", F.substring("entity_key", 3, 20).cast("long"))
    scored = rows.join(t("customer"), F.col("k") == F.col("c_custkey")).withColumn("fit", X.band(F.col("total"), AFFORDABILITY))
    rn = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc_nulls_last("fit"), "c_custkey"))
    best = scored.withColumn("rn", rn).where("rn <= 3").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return best.select(F.col("n_name").alias("state"), "rn", "c_name", "total", "qty", "fit")
