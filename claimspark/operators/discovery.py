"""From an institution's website to its disclosure page and fee document, over pages that are stored.

Three hops within one budget of visits: the home page; the links on it that speak of a disclosure, then guessed paths; the
document that the row of the fees links to. The visits of the second hop are spent in order and end at the first that
decides, so all its pages are joined at once, as many rows for each institution as the budget allows, and the least place
decides. What a visit costs is counted as if they were made one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.fuzzy import name_on_page
from claimspark.operators.registry_rows import homepage
from claimspark.operators.staging import staged
from claimspark.sources.pages import DISCLOSURE, by_page, is_disclosure_page, is_login_wall

# Visits for each institution, the paths that are guessed, in order, and what the row of the fees is called.
BUDGET = 6
GUESSES = (
    "/mandatory-disclosure", "/mandatory-public-disclosure", "/public-disclosure", "/cbse/mandatory-disclosure", "/disclosure",
    "/mandatory_disclosure", "/appendix-ix",
)
FEE_LABEL = r"fee\s*structure|fees\s*structure|fee\s*details|school\s*fee|fee\s*particulars"
NO_PAGE = r"^(?:#|javascript:|mailto:)"


class _Links(HTMLParser):
    """Links in page order, each with the table rows it stands in; a row's text is that of all inside of it."""

    def __init__(self) -> None:
        super().__init__()
        self.links: list[tuple[str, list[str], list[int]]] = []
        self.rows: list[list[str]] = []
        self.open_rows: list[int] = []
        self.open_link: list[str] | None = None
        self.quiet = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.quiet += 1
        elif tag == "table":
            self.open_rows.append(-1)
        elif tag == "tr":
            if self.open_rows and self.open_rows[-1] >= 0:  # the row before was not closed
                self.open_rows.pop()
            self.open_rows.append(len(self.rows))
            self.rows.append([])
        elif tag == "a":
            href = dict(attrs).get("href")
            self.open_link = None if href is None else []
            if href is not None:
                self.links.append((href.strip(), self.open_link, [r for r in self.open_rows if r >= 0]))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.quiet = max(0, self.quiet - 1)
        elif tag == "a":
            self.open_link = None
        elif tag == "tr" and self.open_rows and self.open_rows[-1] >= 0:
            self.open_rows.pop()
        elif tag == "table" and -1 in self.open_rows:
            while self.open_rows.pop() >= 0:
                pass

    def handle_data(self, data: str) -> None:
        if (text := " ".join(data.split())) and not self.quiet:
            if self.open_link is not None:
                self.open_link.append(text)
            for r in self.open_rows:
                if r >= 0:
                    self.rows[r].append(text)


def links_in_rows(pages: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """(key, place, url, href, label, row_ix, row_text): each link of a page, once for each table row it stands in (null outside of tables),
    made absolute against the ``base`` column. Addresses that are none go."""
    kind = pages.schema[key].dataType.simpleString()

    def links(k: object, h: str | None, at: str | None) -> Iterator[tuple]:
        reader = _Links()
        reader.feed(h or "")
        reader.close()
        for place, (href, label, rows) in enumerate(reader.links):
            try:
                url = urljoin(at or "", href)
            except ValueError:
                continue
            for r in rows or [None]:
                yield k, place, url, href, " ".join(label), r, None if r is None else " ".join(reader.rows[r])

    slim = pages.select(F.col(key).alias("k"), F.col(html).alias("h"), F.col(base).alias("b"))
    return by_page(slim, links, f"k {kind}, place int, url string, href string, label string, row_ix int, row_text string").withColumnRenamed("k", key)


def disclosure_targets(links: DataFrame, key: str) -> DataFrame:
    """(key, url, place): distinct addresses of disclosures by link or label; documents first, then the shortest, then in page order."""
    says = F.col("href").rlike(f"(?i){DISCLOSURE}") | F.col("label").rlike(f"(?i){DISCLOSURE}")
    found = links.where(says & F.col("url").rlike("^https?://")).groupBy(key, "url").agg(F.min("place").alias("first"))
    order = Window.partitionBy(key).orderBy(F.lower("url").endswith(".pdf").desc(), F.length("url"), "first")
    return found.select(key, "url", F.row_number().over(order).alias("place"))


def fee_documents(links: DataFrame, key: str) -> DataFrame:
    """(key, fee_url): the first usable link in the first row that speaks of the fees; else the first link that does so itself."""
    usable = (F.col("href") != "") & ~F.lower("href").rlike(NO_PAGE)
    in_row = F.col("row_text").rlike(f"(?i){FEE_LABEL}")
    itself = F.col("href").rlike(f"(?i){FEE_LABEL}") | F.col("label").rlike(f"(?i){FEE_LABEL}")
    by_row = F.min_by(F.when(in_row, F.col("url")), F.when(in_row, F.struct("row_ix", "place")))
    out = links.where(usable & (in_row | itself)).groupBy(key).agg(F.coalesce(by_row, F.min_by(F.when(itself, F.col("url")), F.when(itself, F.col("place")))).alias("fee_url"))
    return out.where("fee_url IS NOT NULL")


def page_text(html: Column) -> Column:
    """What is between the tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def discover(rows: DataFrame, stored: DataFrame, key: str, name: str, website: str, budget: int = BUDGET) -> DataFrame:
    """(key, outcome, mpd_url, fee_url, fetches) of each row. stored: (url, status, body, blocked) of each address once; one that is not there did not
    answer. Outcomes: no_website, dead_origin, login_wall, not_found, found_index, found_fee."""
    base = rows.select(F.col(key).alias("key"), F.col(name).alias("name"), homepage(F.col(website)).alias("base"))
    home = base.where("base IS NOT NULL").join(stored.select(F.col("url").alias("base"), "status", "body"), "base", "left")
    home = staged(home.withColumn("dead", F.col("status").isNull() | (F.col("status") >= 500)), "discovery-home")

    # second hop: the links of the home page, then the guesses that the budget has room for, each address once
    alive = home.where("NOT dead")
    linked = disclosure_targets(links_in_rows(alive.where("body IS NOT NULL").withColumn("at", F.concat("base", F.lit("/"))), "key", "body", "at"), "key")
    guess = alive.select("key", F.posexplode(F.array(*map(F.lit, GUESSES[: max(0, budget - 2)]))).alias("n", "path"), "base")
    guess = guess.select("key", F.concat("base", "path").alias("url"), (F.col("n") + 1_000_000_000).alias("place"))
    targets = linked.unionByName(guess).groupBy("key", "url").agg(F.min("place").alias("place"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("place"))
    targets = targets.select("key", "url", nth.alias("nth")).where(F.col("nth") <= budget - 2)  # one visit is kept for the fee document
    met = targets.join(stored, "url").where("status = 200 AND body IS NOT NULL AND blocked IS NULL").join(alive.select("key", "name", "base"), "key")
    text = page_text(F.col("body"))
    kind = (
        F.when(F.col("body").startswith("%PDF-"), "document")
        .when(is_login_wall(text), "wall")
        .when(is_disclosure_page(text) & name_on_page(F.col("name"), text), "index")
    )
    deciding = met.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("key").agg(F.min_by(F.struct("nth", "kind", "url", "body"), "nth").alias("d")).select("key", "d.*")
    visits = targets.groupBy("key").agg(F.max("nth").alias("all"))
    second = staged(alive.select("key").join(deciding, "key", "left").join(visits, "key", "left"), "discovery-second")

    # third hop
    index = second.where("kind = 'index'")
    fee = fee_documents(links_in_rows(index, "key", "body", "url"), "key")
    fee = fee.join(stored.select(F.col("url").alias("fee_url"), "status", "body", "blocked"), "fee_url", "left")
    fee = fee.select("key", "fee_url", F.coalesce((F.col("status") == 200) & F.col("body").isNotNull() & F.col("blocked").isNull(), F.lit(False)).alias("got"))
    end = second.join(fee, "key", "left")
    used = 1 + F.coalesce("nth", "all", F.lit(0))
    outcome = F.when(F.col("kind") == "document", "found_fee").when(F.col("kind") == "wall", "login_wall").when(F.col("kind").isNull(), "not_found")
    end = end.select(
        "key", outcome.otherwise(F.when(F.col("got"), "found_fee").otherwise("found_index")).alias("outcome"), F.when(F.col("kind") != "wall", F.col("url")).alias("mpd_url"),
        F.when(F.col("kind") == "document", F.col("url")).otherwise(F.col("fee_url")).alias("fee_url"), (used + F.col("fee_url").isNotNull().cast("int")).alias("fetches"),
    )
    nothing = F.lit(None).cast("string")
    never = base.where("base IS NULL").select("key", F.lit("no_website").alias("outcome"), nothing.alias("mpd_url"), nothing.alias("fee_url"), F.lit(0).alias("fetches"))
    gone = home.where("dead").select("key", F.lit("dead_origin").alias("outcome"), nothing.alias("mpd_url"), nothing.alias("fee_url"), F.lit(1).alias("fetches"))
    return end.unionByName(never).unionByName(gone).withColumnRenamed("key", key)
