"""Fees and headcounts out of tables made of orders and their lines, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.operators import fees as E
from claimspark.plans.queries import query

LABELS = {
    "fee": ["tuition fee", "annual fee"], "fee_total_row": ["total fees"], "fee_total_column": ["total"], "instalment": ["instalment", "quarter"], "class_12": ["class 12", "xii"],
    "not_money": ["affiliation"], "result": ["pass percentage"], "strength": ["class wise strength"],
}
#: Of each order up to three tables; what they are about depends on the order's key.
ROWS_SQL = """SELECT l_orderkey AS k, l_linenumber % 3 AS t, 0 AS r, CASE l_orderkey % 5 WHEN 0 THEN ['Class', 'Tuition Fee', 'Total'] WHEN 1 THEN ['Class', 'Quarter fee', 'annual  fee'] WHEN 2 THEN ['Class wise strength', 'Number'] WHEN 3 THEN ['Class', 'Pass Percentage', 'annual fee'] ELSE ['Head', 'Annual Fee'] END AS cells
 FROM lineitem GROUP BY l_orderkey, l_linenumber % 3
 UNION ALL SELECT l_orderkey, l_linenumber % 3, 1 + l_linenumber // 3, CASE l_orderkey % 5 WHEN 0 THEN ['Class ' || (l_linenumber + 8), (l_partkey * 7)::VARCHAR, 'Rs ' || (l_partkey * 30)] WHEN 1 THEN ['Class ' || (11 + l_linenumber // 3), (l_partkey * 9) || ',' || '000']
 WHEN 2 THEN ['Class ' || (l_linenumber + 10), (l_partkey % 80)::VARCHAR || ' of ' || (l_partkey % 60)] WHEN 3 THEN ['Class 12', (l_partkey * 9)::VARCHAR]
 ELSE [CASE l_linenumber WHEN 1 THEN 'Affiliation no' WHEN 2 THEN 'Total Fees' ELSE 'Books' END, (l_partkey * 11)::VARCHAR || ' www.x.in/' || l_partkey || '000%20'] END FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_N = r"list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace({x}, '(?i)(?:https?://|www\.)\S+|\S+\.(?:pdf|docx?|xlsx?|jpe?g|png)\b', ' ', 'g'), '%[0-9A-Fa-f]{{2}}', ' ', 'g'), '\d[\d,]*'), lambda q: replace(q, ',', '')::BIGINT), lambda q: q BETWEEN {low} AND {high})"


def _largest(cells: str, low: int, high: int) -> str:
    return f"list_max({_N.format(x=f"array_to_string({cells}, ' | ')", low=low, high=high)})"


def _has(cells: str, *words: str) -> str:
    text = f"replace(lower(array_to_string({cells}, '|')), ' ', '')"
    return "(" + " OR ".join(f"contains({text}, '{w.replace(' ', '')}')" for w in words) + ")"


FACTS_SQL = f"""rows AS ({ROWS_SQL}), facts AS (SELECT k, t, bool_or({_has("cells", "tuition fee", "annual fee", "total fees")}) AS is_fee, bool_or({_has("cells", "pass percentage")}) AS is_result, bool_or({_has("cells", "instalment", "quarter")}) AS is_part,
 bool_or({_has("cells", "class wise strength")}) AS is_strength, max(CASE WHEN r = 0 AND k % 5 = 0 THEN 3 END) AS total_at FROM rows GROUP BY k, t),
x AS (SELECT rows.*, is_fee, is_result, is_part, is_strength, total_at FROM rows JOIN facts USING (k, t))"""


def page_rows(t) -> DataFrame:
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    s = lambda x: x.cast("string")
    words = lambda *w: F.array(*map(F.lit, w))
    head = F.when(k % 5 == 0, words("Class", "Tuition Fee", "Total")).when(k % 5 == 1, words("Class", "Quarter fee", "annual  fee")).when(k % 5 == 2, words("Class wise strength", "Number")).when(k % 5 == 3, words("Class", "Pass Percentage", "annual fee")).otherwise(words("Head", "Annual Fee"))
    heads = lines.select(k.alias("k"), (n % 3).alias("table_ix"), F.lit(0).alias("row_ix"), head.alias("cells")).distinct()
    grade = lambda x: F.concat(F.lit("Class "), s(x))
    body = F.when(k % 5 == 0, F.array(grade(n + 8), s(p * 7), F.concat(F.lit("Rs "), s(p * 30)))).when(k % 5 == 1, F.array(grade(11 + F.floor(n / 3)), F.concat(s(p * 9), F.lit(",000"))))
    body = body.when(k % 5 == 2, F.array(grade(n + 10), F.concat(s(p % 80), F.lit(" of "), s(p % 60)))).when(k % 5 == 3, F.array(F.lit("Class 12"), s(p * 9)))
    body = body.otherwise(F.array(F.when(n == 1, "Affiliation no").when(n == 2, "Total Fees").otherwise("Books"), F.concat(s(p * 11), F.lit(" www.x.in/"), s(p), F.lit("000%20"))))
    return heads.unionByName(lines.select(k.alias("k"), (n % 3).alias("table_ix"), (1 + F.floor(n / 3)).cast("int").alias("row_ix"), body.alias("cells")))


@query(f"""WITH {FACTS_SQL}, p AS (SELECT k, count(DISTINCT t) AS parts FROM x WHERE is_fee AND is_part GROUP BY k),
l AS (SELECT k, replace(lower(cells[1]), ' ', '') AS label, {_largest("cells[2:]", 1000, 5000000)} AS v FROM x WHERE is_fee AND is_part),
s AS (SELECT k, label, sum(v) AS total FROM l JOIN p USING (k) WHERE v IS NOT NULL AND parts > 1 GROUP BY k, label, parts HAVING count(*) = parts),
summed AS (SELECT k, coalesce(max(total) FILTER (contains(label, 'class12')), max(total)) AS fee FROM s GROUP BY k),
m AS (SELECT k, CASE WHEN r > 0 OR total_at IS NULL THEN {_largest("CASE WHEN total_at <= len(cells) THEN [cells[total_at]] ELSE cells END", 1000, 5000000)} END AS v, CASE WHEN {_has("cells[1:1]", "total fees")} THEN {_largest("cells[2:]", 1000, 5000000)} END AS w, {_has("cells", "class 12", "xii")} AS upper
 FROM x WHERE is_fee AND NOT is_result AND NOT {_has("cells[1:2]", "affiliation")}),
picked AS (SELECT k, coalesce(max(v) FILTER (upper), max(greatest(v, w))) AS fee FROM m GROUP BY k HAVING max(greatest(v, w)) IS NOT NULL)
SELECT k, coalesce(summed.fee, picked.fee)::BIGINT AS fee FROM summed FULL JOIN picked USING (k)""")
def fees_from_tables(t):
    return E.annual_fee(page_rows(t), "k", LABELS).select("k", "fee")


@query(f"""WITH {FACTS_SQL}, c AS (SELECT k, t, r, {_largest("cells", 1, 5000)} AS total FROM x WHERE is_strength AND NOT is_result AND {_has("cells", "class 12", "xii")})
SELECT k, arg_min(total, t * 1000 + r) AS total FROM c WHERE total IS NOT NULL GROUP BY k""")
def class_12_headcounts(t):
    return E.class_12_total(page_rows(t), "k", LABELS).select("k", "total")


@query(f"""WITH rows AS ({ROWS_SQL}), v AS (SELECT k, cells[len(cells)] AS value, t, r FROM rows WHERE {_has("cells[1:1]", "books", "total fees")}),
f AS (SELECT k, arg_min(value, t * 1000 + r) AS value FROM v GROUP BY k) SELECT k, list_filter({_N.format(x="value", low=1, high=100000)}, lambda q: true)[1] AS n FROM f WHERE len({_N.format(x="value", low=1, high=100000)}) > 0""")
def labelled_numbers(t):
    return E.labelled_int(page_rows(t), "k", ["books", "total fees"]).select("k", "n")
