"""Registry pages made of customers and suppliers, forty rows or ten cards each, read back; each query with its SQL, which reads no page."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.plans.queries import query
from claimspark.sources import registry_pages as R

_ID = "CASE WHEN k % 45 = 7 THEN 'XX' || k ELSE '' || k END"
_STATUS = "CASE k % 3 WHEN 0 THEN 'Senior Secondary Level' WHEN 1 THEN 'Secondary Level' ELSE 'Middle Class' END"
_ADDRESS = "name || ' ROAD KARNATAKA'"
_SITE = "CASE k % 4 WHEN 0 THEN 'www.site' || k || '.in' WHEN 1 THEN 'NA' ELSE '' END"
_GONE = "CASE WHEN k % 5 = 0 THEN 'Disaffiliated' ELSE 'Switched Over' END"
_STATE_WISE = (
    f"'<tr><td>' || k || '</td><td><b>Aff. No. :</b> ' || {_ID} || '<br>Sch. Code : ' || (k * 3) || '</td><td>State : S' || (k % 7) || ' District : D ' || (k % 30) || '</td><td>' || {_STATUS}"
    f" || '</td><td>Name : ' || name || ' <i>Head/Principal Name:</i> P ' || k || '</td><td>Address : ' || {_ADDRESS} || ' Website : ' || {_SITE} || '</td></tr>'"
)
_CLOSED = f"'<tr><td>' || k || '<td>' || {_ID} || '<td>S' || (k % 7) || '<td>D ' || (k % 30) || '<td>' || {_STATUS} || '<td>' || name || '<td>' || {_GONE} || '<td>R' || (k % 2) || '<td>more'"
_HEAD = "<html><p>Total No. of Schools affiliated with CBSE : 31,999</p><p>Total No Of DisAffiliated Schools : "
LISTS_SQL = "c AS (SELECT c_custkey AS k, c_name AS name, CAST(floor(c_custkey / 40) AS BIGINT) AS page FROM customer)"


def list_pages(t):
    c = t("customer").selectExpr("c_custkey AS k", "c_name AS name", "CAST(floor(c_custkey / 40) AS BIGINT) AS page")
    rows = c.select("page", "k", F.when(F.col("page") % 2 == 0, F.expr(_STATE_WISE)).otherwise(F.expr(_CLOSED)).alias("row"))
    one = rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), "").alias("rows"))  # forty
    return one.select("page", F.concat(F.lit(_HEAD), F.col("n").cast("string"), F.lit("</p><table><tr><th>S No<th>a<th>b<th>c<th>d<th>e</tr><tr><td>too<td>few</tr>"), "rows", F.lit("</table>")).alias("html"))


@query(f"""WITH {LISTS_SQL}, r AS (SELECT *, page % 2 = 0 AS wide, {_ID} AS id FROM c)
SELECT page, id AS affiliation_no, k % 45 = 7 AS skipped, CASE WHEN wide THEN 'state_wise' ELSE 'closed' END AS layout, name, 'S' || (k % 7) AS state, 'D ' || (k % 30) AS district, {_STATUS} AS status, k % 3 = 0 AS has_class_12,
 CASE WHEN wide THEN '' || (k * 3) END AS school_code, CASE WHEN wide THEN 'P ' || k END AS principal_name, CASE WHEN wide THEN {_ADDRESS} END AS address, CASE WHEN wide AND k % 4 = 0 THEN 'www.site' || k || '.in' END AS website,
 CASE WHEN NOT wide THEN {_GONE} END AS affiliation_status, CASE WHEN NOT wide THEN 'R' || (k % 2) END AS region FROM r""")
def registry_list_rows(t):
    return R.list_rows(list_pages(t), "page", "html").drop("row_ix", "excerpt")


@query(f"WITH {LISTS_SQL} SELECT page, count(*) FILTER (k % 45 <> 7) AS parsed, count(*) FILTER (k % 45 = 7) AS skipped, count(*)::INT AS stated FROM c GROUP BY page")
def registry_list_totals(t):
    return R.guarded_totals(list_pages(t), "page", "html")


@query(f"""WITH {LISTS_SQL}, r AS (SELECT 'cbse:' || k AS entity_key, page % 2 = 0 AS wide, * FROM c WHERE k % 45 <> 7),
f AS (SELECT entity_key, 'name' AS field, name AS value, 'Name: ' || name AS evidence FROM r UNION ALL SELECT entity_key, 'state', 'S' || (k % 7), 'State: S' || (k % 7) FROM r UNION ALL SELECT entity_key, 'district', 'D ' || (k % 30), 'District: D ' || (k % 30) FROM r
 UNION ALL SELECT entity_key, 'address', {_ADDRESS}, 'Address: ' || {_ADDRESS} FROM r WHERE wide UNION ALL SELECT entity_key, 'website', 'www.site' || k || '.in', 'Website: www.site' || k || '.in' FROM r WHERE wide AND k % 4 = 0
 UNION ALL SELECT entity_key, 'principal_name', 'P ' || k, 'Head/Principal Name: P ' || k FROM r WHERE wide UNION ALL SELECT entity_key, 'grade_high', {_STATUS}, 'Status: ' || {_STATUS} FROM r
 UNION ALL SELECT entity_key, 'has_class_12', (k % 3 = 0)::VARCHAR, 'Status: ' || {_STATUS} FROM r UNION ALL SELECT entity_key, 'status', 'disaffiliated', 'Affiliation Status: Disaffiliated' FROM r WHERE NOT wide AND k % 5 = 0)
SELECT * FROM f""")
def registry_list_claims(t):
    return R.list_claims(R.list_rows(list_pages(t), "page", "html"))


_CARD = (
    "'<div class=\"card school-card\"><h6>' || CASE WHEN k % 13 = 5 THEN 'no code' ELSE 'KA' || k || ' - ' || name END || '</h6><div class=top-right-badges><span>' || CASE k % 3 WHEN 0 THEN 'Boys' WHEN 1 THEN 'Co-ed.' ELSE 'odd' END"
    " || '</span><span>Day</span></div><div class=school-badges><span>ICSE</span>' || CASE WHEN k % 2 = 0 THEN '<span>ISC</span>' ELSE '' END || '</div><p>Fr. P ' || k || '<br>' || name || ' Road, Ward 3, D' || (k % 9) || ', Kerala, 533 ' || (200 + k % 700) || ', India</p>'"
    " || CASE WHEN k % 4 = 0 THEN '<div class=text-end><a href=\" https://s' || k || '.in \">Site</a></div>' ELSE '' END || '</div>'"
)
CARDS_SQL = "c AS (SELECT s_suppkey AS k, s_name AS name, CAST(floor(s_suppkey / 10) AS BIGINT) AS page FROM supplier)"


def card_pages(t):
    c = t("supplier").selectExpr("s_suppkey AS k", "s_name AS name", "CAST(floor(s_suppkey / 10) AS BIGINT) AS page")
    one = c.select("page", "k", F.expr(_CARD).alias("card")).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda x: x["card"]), "").alias("cards"))  # ten
    return one.select("page", F.concat(F.lit("<p>Showing 1 to 10 of <b>1,928</b> entries</p>"), "cards").alias("html"))


@query(f"""WITH {CARDS_SQL} SELECT page, CASE WHEN k % 13 <> 5 THEN 'KA' || k END AS code, CASE WHEN k % 13 <> 5 THEN name END AS name, CASE WHEN k % 2 = 0 THEN 'ICSE,ISC' ELSE 'ICSE' END AS affiliations, 'Fr. P ' || k AS principal_name, name || ' Road, Ward 3' AS address, 'D' || (k % 9) AS district, 'Kerala' AS state,
 '533' || (200 + k % 700) AS pincode, 'India' AS country, CASE k % 3 WHEN 0 THEN 'Boys' WHEN 1 THEN 'Co-ed.' END AS gender, 'Day' AS residential, CASE WHEN k % 4 = 0 THEN 'https://s' || k || '.in' END AS website, k % 13 = 5 AS skipped, k % 2 = 0 AS has_class_12, 1928 AS total FROM c""")
def registry_cards(t):
    pages = card_pages(t)
    rows = R.cards(pages, "page", "html").drop("card_ix", "excerpt").withColumn("affiliations", F.array_join("affiliations", ","))
    return rows.join(pages.select("page", R.card_total(F.col("html")).alias("total")), "page")


@query(f"""WITH {CARDS_SQL}, r AS (SELECT 'cisce:KA' || k AS entity_key, CASE WHEN k % 2 = 0 THEN 'Affiliation: ICSE, ISC' ELSE 'Affiliation: ICSE' END AS badges, * FROM c WHERE k % 13 <> 5)
SELECT entity_key, 'has_class_12' AS field, (k % 2 = 0)::VARCHAR AS value, badges AS evidence FROM r UNION ALL SELECT entity_key, 'grade_high', '12', badges FROM r WHERE k % 2 = 0 UNION ALL SELECT entity_key, 'name', name, 'Name: ' || name FROM r
UNION ALL SELECT entity_key, 'state', 'Kerala', 'State: Kerala' FROM r UNION ALL SELECT entity_key, 'district', 'D' || (k % 9), 'District: D' || (k % 9) FROM r UNION ALL SELECT entity_key, 'address', name || ' Road, Ward 3', 'Address: ' || name || ' Road, Ward 3' FROM r
UNION ALL SELECT entity_key, 'pincode', '533' || (200 + k % 700), 'Pin Code: 533' || (200 + k % 700) FROM r UNION ALL SELECT entity_key, 'website', 'https://s' || k || '.in', 'Website: https://s' || k || '.in' FROM r WHERE k % 4 = 0
UNION ALL SELECT entity_key, 'principal_name', 'Fr. P ' || k, 'Principal: Fr. P ' || k FROM r UNION ALL SELECT entity_key, 'gender', CASE k % 3 WHEN 0 THEN 'Boys' ELSE 'Co-ed.' END, 'School Type: ' || CASE k % 3 WHEN 0 THEN 'Boys' ELSE 'Co-ed.' END FROM r WHERE k % 3 < 2
UNION ALL SELECT entity_key, 'residential', 'Day', 'School Classification: Day' FROM r""")
def registry_card_claims(t):
    return R.card_claims(R.cards(card_pages(t), "page", "html"))


@query(f"""WITH c AS (SELECT c_custkey AS k, c_name AS name FROM customer)
SELECT k, 'name' AS field, name AS value, 'Name of Institution: ' || name AS evidence FROM c UNION ALL SELECT k, 'pincode', '' || (560000 + k % 900), 'Pin Code: ' || (560000 + k % 900) FROM c UNION ALL SELECT k, 'grade_high', {_STATUS}, 'Status of the School: ' || {_STATUS} FROM c WHERE k % 6 > 0
UNION ALL SELECT k, 'has_class_12', (k % 3 = 0)::VARCHAR, 'Status of the School: ' || {_STATUS} FROM c WHERE k % 6 > 0
UNION ALL SELECT k, f, v, 'Affiliation Period: From 01/04/2020 To 31/03/' || (2021 + k % 9) FROM c, (VALUES ('board_valid_from'), ('board_valid_to')) n(f), LATERAL (SELECT CASE f WHEN 'board_valid_from' THEN '01/04/2020' ELSE '31/03/' || (2021 + k % 9) END AS v) WHERE k % 2 = 0""")
def registry_details(t):
    status = f"CASE WHEN k % 6 > 0 THEN '<tr><td>Status of the School :<td>' || {_STATUS} || '</tr>' ELSE '<tr><td>Status of the School<td> </tr>' END"
    period = "CASE WHEN k % 2 = 0 THEN '<tr><td>Affiliation Period<td>From : <b>01/04/2020</b> To : 31/03/' || (2021 + k % 9) || '</tr>' ELSE '' END"
    html = f"'<table><tr><td>Name of Institution</td><td>' || name || '</td></tr><tr><td>Gender<td>Female</tr><tr><td>Pin Code<td>' || (560000 + k % 900) || '</tr>' || {status} || {period} || '</table>'"
    return R.detail_claims(t("customer").selectExpr("c_custkey AS k", "c_name AS name").selectExpr("k", f"replace({html}, ' :<td>', '<td>') AS html"), "k", "html")
