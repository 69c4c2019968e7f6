"""Served queries on institutions made of customers, nations and orders, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.operators import served as V
from claimspark.plans.queries import query

INST_SQL = """inst AS (SELECT c_custkey AS id, c_name || CASE c_custkey % 20 // 5 WHEN 0 THEN ' Kendriya Vidyalaya' WHEN 1 THEN ' Delhi Public' WHEN 2 THEN ' Govt Model' ELSE ' Lotus' END AS canonical_name,
 CASE WHEN c_custkey % 5 <> 0 THEN 'Town ' || (c_custkey % 40) END AS city, 'District ' || (c_custkey % 61) AS district, CASE WHEN c_custkey % 6 = 0 THEN 'Metro ' || (c_custkey % 9) END AS metro_area, n_name AS state,
 CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey END AS phone, CASE WHEN c_custkey % 4 = 0 THEN 'm' || c_custkey END AS email, CASE WHEN c_custkey % 7 <> 0 THEN 'w' || (c_custkey % 997) END AS website,
 CASE WHEN c_custkey % 8 = 0 THEN c_custkey % 500 END AS fee_mid, CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 300 END AS total_enrollment, CASE WHEN c_custkey % 13 = 0 THEN 100 END AS student_count_guessed,
 CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 2 = 0 END AS has_class_12, CASE WHEN c_acctbal < 0 THEN 'closed' ELSE 'active' END AS status, CASE WHEN c_custkey % 11 = 0 THEN 'Trust ' || (c_custkey % 90) END AS legal_entity_name,
 CASE WHEN c_custkey % 3 = 1 THEN TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 1 DAY * (c_custkey % 400) END AS last_enriched_at, CASE WHEN c_custkey % 12 <> 0 THEN (c_custkey % 1000) / 10.0::DOUBLE END AS fit,
 CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR END AS cbse_id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR END AS cisce_id FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def institutions(t) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    tail = F.when(k % 20 < 5, " Kendriya Vidyalaya").when(k % 20 < 10, " Delhi Public").when(k % 20 < 15, " Govt Model").otherwise(" Lotus")
    visited = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz") - F.make_dt_interval((k % 400).cast("int"))
    return t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"), F.concat("c_name", tail).alias("canonical_name"), F.when(k % 5 != 0, text("Town ", k % 40)).alias("city"), text("District ", k % 61).alias("district"),
        F.when(k % 6 == 0, text("Metro ", k % 9)).alias("metro_area"), F.col("n_name").alias("state"), F.when(k % 3 == 0, text("p", k)).alias("phone"), F.when(k % 4 == 0, text("m", k)).alias("email"),
        F.when(k % 7 != 0, text("w", k % 997)).alias("website"), F.when(k % 8 == 0, k % 500).alias("fee_mid"), F.when(k % 10 == 0, k % 300).alias("total_enrollment"), F.when(k % 13 == 0, 100).alias("student_count_guessed"),
        F.when(k % 9 != 0, k % 2 == 0).alias("has_class_12"), F.when(F.col("c_acctbal") < 0, "closed").otherwise("active").alias("status"), F.when(k % 11 == 0, text("Trust ", k % 90)).alias("legal_entity_name"),
        F.when(k % 3 == 1, visited).alias("last_enriched_at"), F.when(k % 12 != 0, (k % 1000) / 10.0).alias("fit"), F.when(k % 2 == 0, k.cast("string")).alias("cbse_id"), F.when(k % 5 == 0, k.cast("string")).alias("cisce_id"),
    )


_SITE = "(last_enriched_at IS NOT NULL AND website IS NOT NULL)"
_DIRECT = "(phone IS NOT NULL OR email IS NOT NULL)"
_TIER = f"CASE WHEN {_DIRECT} THEN 'verified' WHEN {_SITE} THEN 'weak' ELSE 'none' END"


def _known(*columns: str) -> str:
    return " + ".join(f"({c} IS NOT NULL)::INT" for c in columns)


@query(f"""WITH {INST_SQL} SELECT id, contact, class12, rank FROM (
 SELECT id, contact, class12, row_number() OVER (PARTITION BY contact, class12 ORDER BY {_known("phone", "email", "fee_mid", "total_enrollment", "website")} DESC, has_class_12 DESC NULLS FIRST, coalesce(fit, 0) DESC, id) AS rank
 FROM inst, (VALUES ('verified'), ('weak'), ('reachable'), ('none'), ('any'), ('odd')) f(contact), (VALUES ('any'), ('yes'), ('unconfirmed')) g(class12)
 WHERE lower(state) = lower((SELECT min(n_name) FROM nation)) AND status = 'active'
 AND CASE contact WHEN 'verified' THEN {_DIRECT} WHEN 'weak' THEN NOT {_DIRECT} AND {_SITE} WHEN 'reachable' THEN {_DIRECT} OR {_SITE} WHEN 'none' THEN NOT {_DIRECT} AND NOT {_SITE} ELSE true END
 AND CASE class12 WHEN 'yes' THEN has_class_12 WHEN 'unconfirmed' THEN NOT has_class_12 ELSE true END) WHERE rank <= 200""")
def served_by_state(t):
    state = t("nation").agg(F.min("n_name")).first()[0]
    rows, out = institutions(t), None
    for contact in ("verified", "weak", "reachable", "none", "any", "odd"):
        for class_12 in ("any", "yes", "unconfirmed"):
            got = V.in_state(rows, state.title(), contact, class_12).agg(F.collect_list("id").alias("ids"))  # 200 at most
            got = got.select(F.posexplode("ids").alias("rank", "id")).select("id", F.lit(contact).alias("contact"), F.lit(class_12).alias("class12"), (F.col("rank") + 1).cast("long").alias("rank"))
            out = got if out is None else out.unionByName(got)
    return out


@query(f"""WITH {INST_SQL}, q(q) AS (VALUES ('town 7'), ('metro 3'), ('district 1'), ('nowhere')) SELECT q, id, rank FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY {_known("phone", "email", "fee_mid")} DESC, has_class_12 DESC NULLS FIRST, id) AS rank
 FROM inst, q WHERE status = 'active' AND (lower(city) = q OR lower(district) = q OR lower(coalesce(metro_area, '')) = q OR lower(district) LIKE '%' || q || '%')) WHERE rank <= 200""")
def served_by_city(t):
    out = None
    for q in ("town 7", "metro 3", "district 1", "nowhere"):
        got = V.in_city(institutions(t), q.title()).agg(F.collect_list("id").alias("ids")).select(F.lit(q).alias("q"), F.posexplode("ids").alias("rank", "id"))
        got = got.select("q", "id", (F.col("rank") + 1).cast("long").alias("rank"))
        out = got if out is None else out.unionByName(got)
    return out


def _trigram_sql(column: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH {INST_SQL}, q(name, q) AS (VALUES ('kv', 'kendriya vidyalaya'), ('lotus town 7', 'lotus town 7'), ('lotus nowhere', 'lotus nowhere'), ('vidyalya', 'vidyalya'), ('zzzqqq', 'zzzqqq'), ('GOVT', 'GOVT')),
v AS (SELECT *, string_split(regexp_replace(lower(concat_ws(' ', canonical_name, city, district, state, legal_entity_name)), '[^a-z0-9]+', ' ', 'g'), ' ') AS words, {_trigram_sql("canonical_name")} AS g FROM inst WHERE status = 'active'),
hit AS (SELECT name, q, v.* FROM v, q WHERE list_has_all(words, string_split(lower(q), ' '))),
loose AS (SELECT name, q, v.* FROM v, (SELECT *, {_trigram_sql("q")} AS qg FROM q) WHERE q NOT LIKE '% %' AND name NOT IN (SELECT name FROM hit) AND len(list_intersect(g, qg)) / len(list_distinct(list_concat(g, qg)))::DOUBLE >= 0.3)
SELECT name, id, rank FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY contains(lower(canonical_name), lower(q)) DESC, {_known("phone", "email", "fee_mid")} DESC, has_class_12 DESC NULLS FIRST, id) AS rank
 FROM (SELECT * FROM hit UNION ALL SELECT * FROM loose)) WHERE rank <= 200""")
def served_by_name(t):
    out = None
    for q in ("kv", "lotus town 7", "lotus nowhere", "vidyalya", "zzzqqq", "GOVT"):
        got = V.by_name(institutions(t), q).agg(F.collect_list("id").alias("ids")).select(F.lit(q).alias("name"), F.posexplode("ids").alias("rank", "id"))
        got = got.select("name", "id", (F.col("rank") + 1).cast("long").alias("rank"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"WITH {INST_SQL} SELECT lower(district) AS place FROM inst WHERE status = 'active' AND district IS NOT NULL UNION SELECT lower(metro_area) FROM inst WHERE metro_area IS NOT NULL")
def served_places(t):
    return V.known_places(institutions(t))


@query(f"""WITH {INST_SQL}, p AS (SELECT lower(district) AS place FROM inst WHERE status = 'active' UNION SELECT lower(metro_area) FROM inst WHERE metro_area IS NOT NULL)
SELECT id, CASE WHEN lower(metro_area) IN (SELECT place FROM p) THEN 'https://list.example/' || replace(metro_area, ' ', '-') END AS link FROM inst""")
def served_place_links(t):
    rows = institutions(t)
    return V.place_link(rows, V.known_places(rows), "https://list.example/", "metro_area").select("id", "link")


@query(f"""WITH {INST_SQL} SELECT count(*) AS institutions, count(*) FILTER (has_class_12) AS senior_secondary, count(website) AS with_website, count(phone) AS with_phone, count(email) AS with_email, count(fee_mid) AS with_fee,
 count(total_enrollment) AS with_students, count(*) FILTER (total_enrollment IS NOT NULL OR student_count_guessed IS NOT NULL) AS with_students_or_guessed, count(*) FILTER ({_DIRECT} OR {_SITE}) AS contactable,
 count(*) FILTER ({_DIRECT}) AS strongly_contactable, count(DISTINCT state) AS states FROM inst WHERE status = 'active'""")
def served_coverage(t):
    return V.coverage(institutions(t))


ROLES_SQL = """roles AS (SELECT o_orderkey AS role_id, o_custkey AS institution_id, 'Person ' || (o_orderkey % 700) AS full_name, CASE o_orderkey % 4 WHEN 0 THEN 'principal' WHEN 1 THEN 'career_counsellor' WHEN 2 THEN 'academic_coordinator' ELSE 'other' END AS title FROM orders),
boards AS (SELECT DISTINCT o_custkey AS institution_id, 'B' || o_orderstatus AS board FROM orders),
scores AS (SELECT o_custkey AS institution_id, o_orderdate AS computed_at, o_orderkey % 90 AS fit, o_orderkey % 50 AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'a; b' ELSE 'c' END AS flags, o_orderkey FROM orders)"""
PROFILE = ("id", "canonical_name", "district", "city", "state", "metro_area", "website", "email", "phone", "fee_mid", "total_enrollment", "student_count_guessed", "has_class_12", "status", "legal_entity_name")


def _profile(t) -> DataFrame:
    o, k = t("orders"), F.col("o_orderkey")
    title = F.when(k % 4 == 0, "principal").when(k % 4 == 1, "career_counsellor").when(k % 4 == 2, "academic_coordinator").otherwise("other")
    roles = o.select(k.alias("role_id"), F.col("o_custkey").alias("institution_id"), F.concat(F.lit("Person "), (k % 700).cast("string")).alias("full_name"), title.alias("title"))
    boards = o.select(F.col("o_custkey").alias("institution_id"), F.concat(F.lit("B"), "o_orderstatus").alias("board")).distinct()
    flags = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c")))
    scores = o.select(F.col("o_custkey").alias("institution_id"), F.struct("o_orderdate", k).alias("computed_at"), (k % 90).alias("fit"), (k % 50).alias("confidence"), flags.alias("flags"))
    return V.profile(institutions(t), roles, boards, scores, PROFILE)


_PROFILE_SQL = f"""SELECT {", ".join("i." + c for c in PROFILE)}, (SELECT arg_min(full_name, role_id) FROM roles r WHERE r.institution_id = i.id AND title = 'principal') AS principal_name,
 (SELECT arg_min(full_name, role_id) FROM roles r WHERE r.institution_id = i.id AND title IN ('career_counsellor', 'academic_coordinator')) AS counsellor_name,
 (SELECT string_agg(board, ', ' ORDER BY board) FROM boards b WHERE b.institution_id = i.id) AS boards, s.fit, s.confidence, s.flags, {_TIER} AS contact_tier
 FROM inst i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY computed_at DESC, o_orderkey DESC) AS rn FROM scores) s ON s.institution_id = i.id AND rn = 1"""


@query(f"WITH {INST_SQL}, {ROLES_SQL} {_PROFILE_SQL}")
def served_profile(t):
    return _profile(t).withColumn("flags", F.array_join("flags", "; "))


EXPORT = (
    ("canonical_name", "Name"), ("district", "District"), ("city", "City"), ("state", "State"), ("phone", "Phone"), ("email", "Email"), ("website", "Website"), ("fee_mid", "Annual fee"),
    ("total_enrollment", "Students"), ("has_class_12", "Class 12"), ("principal_name", "Principal"), ("boards", "Boards"), ("flags", "Flags"), ("contact_tier", "Contact"),
)


@query(f"WITH {INST_SQL}, {ROLES_SQL}, p AS ({_PROFILE_SQL} ORDER BY i.id LIMIT 5000) SELECT " + ", ".join(f"coalesce({c}::VARCHAR, '') AS \"{label}\"" for c, label in EXPORT) + " FROM p")
def served_export(t):
    return V.export_rows(_profile(t), EXPORT)


@query(f"""WITH {INST_SQL} SELECT id, coalesce('cbse:' || cbse_id, 'cisce:' || cisce_id) AS entity_key, website FROM inst WHERE status = 'active' AND has_class_12 AND website IS NOT NULL AND coalesce(cbse_id, cisce_id) IS NOT NULL
 AND NOT regexp_matches(canonical_name, '(?i)(kendriya|navodaya|government|govt)') AND (last_enriched_at IS NULL OR last_enriched_at < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 180 DAYS)""")
def enrichment_targets(t):
    return V.due_targets(institutions(t), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))


@query(f"WITH {INST_SQL} SELECT id, website FROM inst i WHERE website IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inst o WHERE o.id <> i.id AND o.website = i.website)")
def unshared_websites(t):
    return V.website_twins(institutions(t)).select("id", "website")
