"""Scanned documents made of order lines, and snapshots made of customers; each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.operators import scans as B
from claimspark.operators import signals as D
from claimspark.plans.queries import query

#: Eight orders are a document, each order of them on one of four pages; heights make rows of up to six units.
BOXES_SQL = """b AS (SELECT l_orderkey // 8 AS k, (l_orderkey % 4)::INT AS page, l_orderkey * 10 + l_linenumber AS box_ix, (min(l_suppkey) % 40)::DOUBLE AS x, (min(l_partkey) % 90)::DOUBLE AS y,
 CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'XI TO XII' WHEN 1 THEN (min(l_partkey) % 50) || ',' || '500' WHEN 2 THEN (min(l_partkey) * 37)::VARCHAR WHEN 3 THEN '2024' WHEN 4 THEN '- 25' ELSE 'fee' END AS text FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
LINES_SQL = f"""{BOXES_SQL}, a AS (SELECT k, page, min(y) AS top, 0 AS r FROM b GROUP BY k, page UNION ALL SELECT a.k, a.page, min(b.y), a.r + 1 FROM a JOIN b ON a.k = b.k AND a.page = b.page AND b.y > a.top + 6 GROUP BY a.k, a.page, a.r),
l AS (SELECT b.k, b.page, r AS row_ix, string_agg(text, ' ' ORDER BY x, y, box_ix) AS line FROM b ASOF JOIN a ON b.k = a.k AND b.page = a.page AND b.y >= a.top GROUP BY b.k, b.page, r)"""


def boxes(t):
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("p")
    lines = t("lineitem").groupBy(k, n).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    kind = (k + n) % 6
    text = F.when(kind == 0, "XI TO XII").when(kind == 1, F.concat((p % 50).cast("string"), F.lit(",500"))).when(kind == 2, (p * 37).cast("string")).when(kind == 3, "2024").when(kind == 4, "- 25").otherwise("fee")
    return lines.select(F.floor(k / 8).alias("k"), (k % 4).cast("int").alias("page"), (k * 10 + n).alias("box_ix"), (F.col("s") % 40).cast("double").alias("x"), (p % 90).cast("double").alias("y"), F.lit(500.0).alias("page_height"), text.alias("text"))


@query(f"WITH RECURSIVE {LINES_SQL} SELECT k, page, row_ix, line FROM l")
def scan_rows(t):
    return B.rows_of_boxes(boxes(t), "k")


@query(rf"""WITH RECURSIVE {LINES_SQL}, w AS (SELECT k, string_agg(line, ' ' ORDER BY page, row_ix) AS text FROM l GROUP BY k),
n AS (SELECT *, list_max(list_filter(list_transform(regexp_extract_all(line, '\d[\d,]*'), lambda q: try_cast(replace(q, ',', '') AS BIGINT)), lambda q: q BETWEEN 1000 AND 5000000)) AS v FROM l WHERE contains(replace(lower(line), ' ', ''), 'xii')),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, page, row_ix) AS rk FROM n WHERE v IS NOT NULL)
SELECT w.k, f.v AS fee, substr(f.line, 1, 500) AS evidence, CASE WHEN f.v IS NOT NULL THEN try_cast(regexp_extract(text, '(20\d{{2}})\s*[-/]\s*(?:20)?\d{{2}}\b', 1) AS INT) END AS fee_year, CASE WHEN f.v IS NOT NULL THEN 0.55::DOUBLE END AS confidence, f.v IS NULL AS unreadable,
 CASE WHEN len(list_filter([50000, 100000, 150000, 300000, 600000, 1000000], lambda e: abs(f.v - e) <= e * 0.1::DOUBLE)) > 0 THEN 'near the edge of a band' END AS reason FROM w LEFT JOIN f ON w.k = f.k AND rk = 1""")
def scan_fees(t):
    b = boxes(t)
    return B.fees_of_scans(b.select("k"), B.rows_of_boxes(b, "k"), "k")


#: Every customer is a row of a registry; the earlier snapshot lacks those of one nation, the later one those of another.
_OLD = {
    "level": "CASE WHEN k % 6 = 1 THEN 'Senior Secondary' WHEN k % 6 = 2 THEN 'College' ELSE 'Secondary' END", "principal": "CASE WHEN k % 4 = 2 THEN NULL ELSE concat('Dr. A ', n) END",
    "address": "concat('12, M.G. Road, ', n)", "legal_entity": "concat('Trust ', k % 300, ' Society')",
}
_NEW = {
    "level": "CASE WHEN k % 6 < 2 THEN 'senior secondary ' ELSE 'Secondary' END", "principal": "CASE WHEN k % 4 = 1 THEN concat('Mira Rao ', n) ELSE concat('a  ', upper(n)) END",
    "address": "CASE WHEN k % 5 = 1 THEN concat('14 M G Road ', n) WHEN k % 10 = 2 THEN NULL ELSE concat('12  M G ROAD ', n) END", "legal_entity": "CASE WHEN k % 3 = 0 THEN concat('Fresh ', n) ELSE concat('society TRUST ', k % 300) END",
}


@query(f"""WITH c AS (SELECT c_custkey AS k, c_name AS n, c_nationkey AS p FROM customer), o AS (SELECT k, {", ".join(f"{v} AS {c}" for c, v in _OLD.items())} FROM c WHERE p <> 7), w AS (SELECT k, {", ".join(f"{v} AS {c}" for c, v in _NEW.items())} FROM c WHERE p <> 9),
x AS (SELECT *, p = 7 AS came, p NOT IN (7, 9) AS stays FROM c), known AS (SELECT DISTINCT k % 300 AS e FROM c WHERE p <> 7)
SELECT k, 'new_campus' AS signal_type, NULL::VARCHAR AS before, w.legal_entity AS after FROM x JOIN w USING (k) WHERE came AND k % 3 > 0 AND k % 300 IN (SELECT e FROM known)
UNION ALL SELECT k, 'new_affiliation', NULL, NULL FROM x WHERE came AND NOT (k % 3 > 0 AND k % 300 IN (SELECT e FROM known))
UNION ALL SELECT k, 'disaffiliation', NULL, NULL FROM x WHERE NOT came AND NOT stays
UNION ALL SELECT k, 'level_upgrade', o.level, w.level FROM x JOIN o USING (k) JOIN w USING (k) WHERE stays AND k % 6 = 0
UNION ALL SELECT k, 'principal_change', o.principal, w.principal FROM x JOIN o USING (k) JOIN w USING (k) WHERE stays AND k % 4 = 1
UNION ALL SELECT k, 'address_change', o.address, w.address FROM x JOIN o USING (k) JOIN w USING (k) WHERE stays AND k % 5 = 1""")
def registry_signals(t):
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.col("c_nationkey").alias("p"))
    shot = lambda columns, gone: c.where(F.col("p") != gone).select("k", *[F.expr(v).alias(x) for x, v in columns.items()])
    return D.signals(shot(_OLD, 7), shot(_NEW, 9), "k")
