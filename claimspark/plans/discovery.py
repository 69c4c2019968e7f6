"""Discovery over stored pages: every given page is the home of a site of one of nine kinds; each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.operators import discovery as D
from claimspark.plans.queries import query

_LINKS = {3: "<p><a href='/docs/b1.pdf'>Mandatory Disclosure</a>", 5: "<a href='mpd.html'>Public disclosure</a>", 6: "<a href='/appendix-ix.html'>More</a>", 8: "<a href='mpd.html'>Mandatory public disclosure</a>"}
_ROWS = "<table><tr><td>1</td><td>Copy of society registration</td><td><a href='s.pdf'>View</a></td></tr><tr><td>2</td><td>FEE STRUCTURE of the school</td><td><a href='#'>-</a><a href='files/fees.pdf'>View</a></td></tr></table>"
_FACTS = "<p>Affiliation No. 12, run by a trust, class wise student strength"


def sites(t):
    """(rows, stored): an institution for each page, and what is stored of its site."""
    k = F.col("page_id")
    kind, host = k % 9, F.concat(F.lit("https://site"), k.cast("string"), F.lit(".example"))
    pages = t("pages").select(k.alias("key"), kind.alias("kind"), host.alias("host"), F.concat(F.lit("Lotus Meadow Academy "), k.cast("string")).alias("name"), "html")
    rows = pages.select("key", "name", F.when(F.col("kind") > 0, F.concat(F.substring("host", 9, 99), F.lit("/"))).alias("website"))
    link = F.coalesce(*[F.when(F.col("kind") == n, text) for n, text in _LINKS.items()], F.lit(""))
    home = pages.where("kind > 1").select(F.col("host").alias("url"), F.when(F.col("kind") == 2, 503).when(F.col("kind") == 4, 404).otherwise(200).alias("status"), F.when(~F.col("kind").isin(2, 4), F.concat("html", link)).alias("body"))
    page = lambda n, path, body: pages.where(F.col("kind") == n).select(F.concat("host", F.lit(path)).alias("url"), F.lit(200).alias("status"), body.alias("body"))
    facts = F.concat(F.lit("<h1>"), "name", F.lit(f"</h1>{_FACTS}"))
    stored = [
        page(3, "/docs/b1.pdf", F.lit("%PDF-1.4 proforma")), page(4, "/public-disclosure", F.concat(facts, F.lit(_ROWS))), page(4, "/files/fees.pdf", F.lit("%PDF-1.4 fees")),
        page(5, "/mpd.html", facts), page(6, "/appendix-ix.html", F.lit("<p>Parent login</p>")), page(8, "/mpd.html", F.lit(f"<h1>Quartz Jigsaw Vault</h1>{_FACTS}")),
    ]
    for s in stored:
        home = home.unionByName(s)
    return rows, home.withColumn("blocked", F.lit(None).cast("string"))


@query("""WITH p AS (SELECT page_id AS key, page_id % 9 AS kind, 'https://site' || page_id || '.example' AS host FROM pages)
SELECT key, ['no_website', 'dead_origin', 'dead_origin', 'found_fee', 'found_fee', 'found_index', 'login_wall', 'not_found', 'not_found'][kind + 1] AS outcome,
 host || CASE kind WHEN 3 THEN '/docs/b1.pdf' WHEN 4 THEN '/public-disclosure' WHEN 5 THEN '/mpd.html' END AS mpd_url, host || CASE kind WHEN 3 THEN '/docs/b1.pdf' WHEN 4 THEN '/files/fees.pdf' END AS fee_url,
 [0, 1, 1, 2, 5, 2, 2, 5, 5][kind + 1] AS fetches FROM p""")
def discovery_outcomes(t):
    return D.discover(*sites(t), "key", "name", "website")


@query("""SELECT page_id, list_sort(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: x)) AS hrefs, len(regexp_extract_all(html, '<a href="')) AS n FROM pages WHERE contains(html, '<a href="')""")
def links_of_pages(t):
    links = D.links_in_rows(t("pages"), "page_id", "html", "url")
    return links.groupBy("page_id").agg(F.array_sort(F.collect_list("href")).alias("hrefs"), F.count(F.lit(1)).alias("n"))
