"""Names after labels, addresses in normal form and sorted pages on the tables at hand, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.functions import spans as S
from claimspark.operators import paging as P
from claimspark.plans.queries import query
from claimspark.plans.served import INST_SQL, institutions

_CASES = ["Principal : Dr. Ravi Kumar Rao, M.Sc.", "from the Principal''s Desk Message Anita Rao", "Head of the School - Mrs. Mira\tSen", "PRINCIPAL QUALIFICATION Msc Bed", "principal  smt. lower case", "headmistress O''Neil Ann-Marie. Welcome"]
_TEXT = "concat(coalesce(text, ''), ' ', CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CASES)) + " ELSE 'nobody' END, ' ', lang)"


@query(f"""WITH d AS (SELECT doc_id, {_TEXT.replace(chr(9), "' || chr(9) || '")} AS t FROM documents), a AS (SELECT *, regexp_extract(t, '(?is)^(.*?)({S.HEAD_LABEL})(.{{0,120}})', ['b', 'l', 'r']) AS p FROM d),
n AS (SELECT *, regexp_extract(p.r, $$(?s)^(.*?)({S.NAME})$$, ['b', 'n']) AS q FROM a WHERE p.l <> '' AND NOT regexp_matches(p.r, '(?i){S.NO_NAME}')),
o AS (SELECT *, length(p.b) + length(p.l) + length(q.b) AS start FROM n WHERE q.n <> '')
SELECT doc_id, q.n AS given, start::INT AS start, trim(regexp_replace(substr(t, greatest(start - 60, 0) + 1, least(start, 60) + length(q.n) + 60), '\\s+', ' ', 'g')) AS evidence FROM o""")
def names_after_labels(t):
    found = t("documents").select("doc_id", F.expr(_TEXT).alias("text")).select("doc_id", S.name_after_label(F.col("text")).alias("p"))
    found = found.select("doc_id", F.explode(F.array_compact(F.array("p"))).alias("p"))  # a filter would be pushed below and read each text again
    return found.select("doc_id", "p.given", "p.start", "p.evidence")


_URL = "concat(CASE WHEN page_id % 2 = 0 THEN ' HTTPS' ELSE 'http' END, substr(url, position('://' IN url)), '/md/C1.FEE STRUCTURE (é).pdf', CASE page_id % 3 WHEN 0 THEN '?a b=ü&c=%20#end' WHEN 1 THEN '#x y' ELSE '?' END)"


def _encoded_sql(text: str, safe: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: CASE WHEN contains('{safe}', c) THEN c ELSE url_encode(c) END), '')"


@query(f"""WITH u AS (SELECT page_id, trim({_URL}) AS u FROM pages), s AS (SELECT page_id, lower(split_part(u, '://', 1)) AS scheme, split_part(substr(u, strpos(u, '://') + 3), '#', 1) AS rest FROM u),
p AS (SELECT page_id, scheme, regexp_extract(rest, '^[^/?]*') AS host, split_part(regexp_replace(rest, '^[^/?]*', ''), '?', 1) AS path, CASE WHEN contains(rest, '?') THEN substr(rest, strpos(rest, '?') + 1) ELSE '' END AS query FROM s)
SELECT page_id, scheme || '://' || host || {_encoded_sql("path", S.SAFE_IN_PATH)} || CASE WHEN query <> '' THEN '?' || {_encoded_sql("query", S.SAFE_IN_QUERY)} ELSE '' END AS normal FROM p""")
def normal_urls(t):
    return t("pages").select("page_id", S.normal_url(F.expr(_URL)).alias("normal"))


_COLUMNS = {
    "confidence": "id % 77", "fee_annual_inr_min": "CASE WHEN id % 3 > 0 THEN id % 40 * 1000 END", "fee_annual_inr_max": "CASE WHEN id % 4 > 0 THEN id % 50 * 1100 END", "pcm_12_count": "CASE WHEN id % 5 = 0 THEN id % 30 END", "class_12_total": "CASE WHEN id % 2 = 0 THEN id % 90 END",
}
_BY = {s: e.replace("2D", "2::DOUBLE") for s, e in P.SORTS.items()}
SIZE = 40


@query(f"WITH {INST_SQL}, r AS (SELECT id, fit, total_enrollment, {', '.join(f'{e} AS {c}' for c, e in _COLUMNS.items())} FROM inst)" + " UNION ALL ".join(f" SELECT '{s}' AS sort, {d} AS descending, id, v AS sort_value, 1 + (rn > {SIZE})::INT AS page FROM (SELECT id, v, row_number() OVER (ORDER BY v {'DESC' if d else 'ASC'} NULLS LAST, id) AS rn FROM (SELECT id, ({e})::DOUBLE AS v FROM r)) WHERE rn <= {2 * SIZE}" for s, e in _BY.items() for d in (True, False)))
def sorted_pages(t):
    rows = institutions(t).select("id", "fit", "total_enrollment", *[F.expr(e).alias(c) for c, e in _COLUMNS.items()])
    out = None
    for sort in P.SORTS:
        for descending in (True, False):
            first = P.page(rows, sort, SIZE, descending=descending)
            second = P.page(rows, sort, SIZE, descending=descending, after=P.token(first, descending=descending))
            for n, shown in ((1, first), (2, second)):
                got = shown.select(F.lit(sort).alias("sort"), F.lit(descending).alias("descending"), "id", "sort_value", F.lit(n).alias("page"))
                out = got if out is None else out.unionByName(got)
    return out
