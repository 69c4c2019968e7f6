"""Record linkage on rows made of customers, with variants of every tenth, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.operators import matching as M
from claimspark.operators.components import merge_components
from claimspark.plans.queries import query

#: Rows in words that both dialects read. Variants: another generic word; a typed name; another PIN of the town; a branch.
_STEP = "CAST(floor(k / {}) AS BIGINT)"
_NAME = (
    "CASE k % 7 WHEN 0 THEN 'Amber' WHEN 1 THEN 'Birch' WHEN 2 THEN 'Cedar' WHEN 3 THEN 'Dahlia' WHEN 4 THEN 'Elder' WHEN 5 THEN 'Fern' ELSE 'Ginkgo' END || ' ' || "
    f"CASE {_STEP.format(7)} % 6 WHEN 0 THEN 'Hill' WHEN 1 THEN 'Meadow' WHEN 2 THEN 'Orchard' WHEN 3 THEN 'Quarry' WHEN 4 THEN 'Ridge' ELSE 'Valley' END || ' ' || lower(seg)"
)
_KIND = f"{_STEP.format(10)} % 4"
RECORDS_SQL = f"""SELECT k + v * 100000000 AS key, {_NAME} || CASE WHEN v = 0 THEN ' School' WHEN {_KIND} = 0 THEN ' Academy' WHEN {_KIND} = 1 THEN 'x School' WHEN {_KIND} = 2 THEN ' School' ELSE ' School North' END AS name,
 'Town ' || (k % 211) AS city, 'Area ' || (k % 97) AS district, 'State ' || (k % 25) AS state,
 '' || CASE WHEN v = 1 AND {_KIND} >= 2 THEN 560000 + (k + 1) % 1000 ELSE 560000 + k % 1000 END AS pincode,
 CASE WHEN k % 3 > 0 THEN 'www.site' || k || '.example.in' END AS website, CASE WHEN k % 4 > 0 THEN '' || (9800000000 + k) END AS phone,
 CASE WHEN k % 5 = 0 THEN 'Trust ' || (k % 17) END AS legal_entity, 10.0E0 + (k % 1000) / 50.0E0 AS latitude, 75.0E0 + (k % 1000) / 50.0E0 AS longitude,
 CASE WHEN k % 6 = 0 THEN 'U' || k END AS udise_code, CASE WHEN k % 6 = 1 AND v = 0 THEN 'C' || k END AS cbse_affiliation_no
 FROM base WHERE v = 0 OR k % 10 = 3"""
DECIDED_SQL = "SELECT k AS a, k + 100000000 AS b, CASE WHEN k % 40 = 3 THEN 'different' ELSE 'same' END AS decision FROM base WHERE v = 1 AND k % 20 = 3"

PAIRS_SQL = f"""base AS (SELECT c_custkey AS k, c_mktsegment AS seg, v FROM customer, (VALUES (0), (1)) vs(v)),
records AS ({RECORDS_SQL}),
r AS (SELECT key, list_sort(list_filter(string_split(lower(name), ' '), lambda x: x NOT IN ('school', 'academy'))) AS t, string_split(lower(name), ' ') AS w, city, pincode AS pin, 'site' || nullif(key % 100000000, -1) AS s, CASE WHEN website IS NOT NULL THEN regexp_extract(website, '(example.in)') END AS domain,
 phone, lower(legal_entity) AS legal, latitude, longitude, udise_code, cbse_affiliation_no, district, state FROM records),
b AS (SELECT key, 'p' || pin AS block FROM r UNION SELECT key, 'n' || state || '|' || substr(array_to_string(t, ' '), 1, 6) FROM r UNION SELECT key, 'd' || domain FROM r WHERE domain IS NOT NULL
 UNION SELECT key, 't' || phone FROM r WHERE phone IS NOT NULL UNION SELECT key, 'w' || district || '|' || t[1] || ' ' || t[2] FROM r),
met AS (SELECT DISTINCT x.key AS a, y.key AS b FROM b x JOIN b y ON x.block = y.block AND x.key < y.key),
p AS (SELECT x.key AS a, y.key AS b, x.t AS xt, y.t AS yt, (CASE WHEN x.pin = y.pin THEN 1.0 WHEN substr(x.pin, 1, 3) = substr(y.pin, 1, 3) THEN 0.4 ELSE 0.0 END)::DOUBLE AS pin, coalesce(x.domain = y.domain, false)::INT::DOUBLE AS domain, coalesce(x.phone = y.phone, false)::INT::DOUBLE AS phone,
 coalesce(x.legal = y.legal, false)::INT::DOUBLE AS legal, greatest(0, least(1, (25 - 2 * 6371 * asin(sqrt(least(1, sin(radians(y.latitude - x.latitude) / 2) ^ 2 + cos(radians(x.latitude)) * cos(radians(y.latitude)) * sin(radians(y.longitude - x.longitude) / 2) ^ 2)))) / 23))::DOUBLE AS geo
 FROM met JOIN r x ON x.key = a JOIN r y ON y.key = b
 WHERE NOT (x.pin <> y.pin AND x.city <> y.city) AND NOT coalesce(x.udise_code <> y.udise_code, false) AND NOT coalesce(x.cbse_affiliation_no <> y.cbse_affiliation_no, false)
 AND NOT (x.pin <> y.pin AND list_has_any(x.w, y.w) AND ((len(list_filter(x.w, lambda e: NOT list_contains(y.w, e))) = 0 AND list_filter(y.w, lambda e: NOT list_contains(x.w, e)) = ['north']) OR (len(list_filter(y.w, lambda e: NOT list_contains(x.w, e))) = 0 AND list_filter(x.w, lambda e: NOT list_contains(y.w, e)) = ['north'])))),
u AS (SELECT *, array_to_string(list_sort(list_intersect(xt, yt)), ' ') AS both_, array_to_string(list_filter(xt, lambda e: NOT list_contains(yt, e)), ' ') AS ox, array_to_string(list_filter(yt, lambda e: NOT list_contains(xt, e)), ' ') AS oy FROM p
 WHERE 0.35 + 0.25 * pin + 0.15 * domain + 0.10 * phone + 0.10 * geo + 0.05 * legal >= 0.649),
l AS (SELECT *, length(ox) - bit_count(list_reduce(list_concat([(1::HUGEINT << length(ox)) - 1], list_transform(string_split(oy, ''), lambda c: list_sum(list_transform(range(length(ox)), lambda i: CASE WHEN ox[i + 1] = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT)),
 lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::HUGEINT << length(ox)) - 1))) AS common FROM u),
named AS (SELECT *, CASE WHEN both_ <> '' AND (ox = '' OR oy = '') THEN 1.0 WHEN both_ = '' THEN 2.0 * common / (length(ox) + length(oy))
 ELSE greatest(2.0 * (length(both_) + 1 + common) / (2 * length(both_) + 2 + length(ox) + length(oy)), 2.0 * length(both_) / (2 * length(both_) + 1 + length(ox)), 2.0 * length(both_) / (2 * length(both_) + 1 + length(oy))) END AS name FROM l),
scored AS (SELECT a, b, round(0.35 * name + 0.25 * pin + 0.15 * domain + 0.10 * phone + 0.10 * geo + 0.05 * legal, 6) AS score FROM named WHERE round(0.35 * name + 0.25 * pin + 0.15 * domain + 0.10 * phone + 0.10 * geo + 0.05 * legal, 6) >= 0.65),
decided AS ({DECIDED_SQL}),
matched AS (SELECT coalesce(s.a, d.a) AS a, coalesce(s.b, d.b) AS b, score, coalesce(d.decision, CASE WHEN score >= 0.90 THEN 'same' ELSE 'review' END) AS decision FROM scored s FULL JOIN decided d ON s.a = d.a AND s.b = d.b WHERE coalesce(d.decision, '') <> 'different')"""


def records(t):
    """(records, decided) as in the SQL."""
    rows = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    pick = lambda sql: rows.where(sql.split(" WHERE ")[-1]).selectExpr(*_columns(sql))
    return pick(RECORDS_SQL), pick(DECIDED_SQL)


def _columns(sql: str) -> list[str]:
    """The select list of one of the two texts above, cut at commas outside of brackets."""
    out, depth = [""], 0
    for c in sql.split("SELECT ", 1)[1].rsplit("FROM base", 1)[0]:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


@query(f"WITH {PAIRS_SQL} SELECT a, b, round(score, 4) AS score, decision FROM matched")
def matched_pairs(t):
    rows, decided = records(t)
    return M.matched(rows, "key", decided).select("a", "b", F.round("score", 4).alias("score"), "decision")


@query(f"""WITH {PAIRS_SQL}, e AS (SELECT a AS x, b AS y FROM matched WHERE decision = 'same' UNION SELECT b, a FROM matched WHERE decision = 'same')
SELECT x AS key, least(x, min(y)) AS "primary" FROM e GROUP BY x""")
def matched_groups(t):
    """Planted rows have one variant each, so a group is a star around its least key, which the SQL states. Pairs for a person to decide merge nothing."""
    rows, decided = records(t)
    return merge_components(M.matched(rows, "key", decided, review_from=M.MERGE_FROM).where("decision = 'same'"), "a", "b")
