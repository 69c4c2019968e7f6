"""Groups by owner and by brand over all customers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.operators import groups as G
from claimspark.plans.queries import query

_COLUMNS = {
    "id": "c_custkey", "canonical_name": "concat('Lotus', c_custkey % 60, ' Vale, Hall ', c_custkey)", "state": "n_name", "good": "c_acctbal >= 5000",
    "website": "CASE WHEN c_custkey % 60 >= 50 THEN 'https://sites.host.in/x' WHEN c_custkey % 4 > 0 THEN concat('http://www.g', c_custkey % 60, '.co.in/') ELSE concat('https://site', c_custkey, '.in') END",
    "legal_entity_name": "CASE WHEN c_custkey % 60 < 20 THEN concat('Trust ', c_custkey % 60, ' Society') WHEN c_custkey % 60 < 40 THEN concat('TRUST of ', c_custkey % 120) END",
}
_ROWS = f"SELECT {', '.join(f'{e} AS {n}' for n, e in _COLUMNS.items())} FROM customer JOIN nation ON c_nationkey = n_nationkey"


def institutions(t):
    joined = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in _COLUMNS.items()])


@query(f"""WITH r AS (SELECT *, id % 60 AS b, CASE WHEN id % 60 < 20 THEN (id % 60)::VARCHAR WHEN id % 60 < 40 THEN (id % 120) || ' of' END AS owner, CASE WHEN id % 60 < 50 AND id % 4 > 0 THEN id % 60 END AS g FROM ({_ROWS})),
s AS (SELECT owner, state, count(*) AS n FROM r WHERE owner IS NOT NULL GROUP BY ALL), h AS (SELECT owner, arg_min(state, (-n, state)) AS hq_state FROM s GROUP BY owner),
o AS (SELECT owner, count(*) AS campus_count, count(*) FILTER (good) AS qualifying_campus_count FROM r WHERE owner IS NOT NULL GROUP BY owner HAVING count(*) > 1),
x AS (SELECT g, count(*) AS brand_count, count(DISTINCT owner) > 1 OR count(*) > count(owner) AS mixed FROM r WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1)
SELECT id, r.owner, CASE WHEN campus_count IS NOT NULL THEN 'verified_single_owner' WHEN mixed THEN 'possible_franchise_network' END AS group_type, campus_count, qualifying_campus_count, CASE WHEN campus_count IS NOT NULL THEN hq_state END AS hq_state,
 CASE WHEN brand_count IS NOT NULL THEN 'lotus' || r.g || ' vale' END AS brand, brand_count, coalesce(mixed, false) AS is_franchise FROM r LEFT JOIN o ON r.owner = o.owner LEFT JOIN h ON r.owner = h.owner LEFT JOIN x ON r.g = x.g""")
def group_axes(t):
    return G.with_groups(institutions(t), F.col("good")).select("id", "owner", "group_type", "campus_count", "qualifying_campus_count", "hq_state", "brand", "brand_count", "is_franchise")
