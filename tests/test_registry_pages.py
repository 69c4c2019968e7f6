"""Registry pages of both layouts, malformed ones, cards and details, by cases."""

import pytest
from pyspark.sql import functions as F

from claimspark.sources import registry_pages as R

HEAD = "<tr><th>S No</th><th>Aff.</th><th>Geo</th><th>Status</th><th>School</th><th>Contact</th></tr>"
WIDE = "<tr><td>1</td><td>Aff. No. : {}  Sch. Code : 45</td><td>State : KARNATAKA District : BANGALORE URBAN</td><td>Senior Secondary Level</td><td>Name : {} Head/Principal Name : A B</td><td>Address : 1 ROAD BANGALORE KARNATAKA Website : {}</td></tr>"
CLOSED = "<tr><td>400</td><td>{}</td><td>DELHI</td><td>NEW DELHI</td><td>Secondary Level</td><td>{}</td><td>{}</td><td>R1</td><td>x</td></tr>"


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page int, html string")


def test_both_layouts_and_what_is_left_out(spark):
    wide = f"<table>{HEAD}{WIDE.format('330801', 'ONE SCHOOL', 'www.one.in')}{WIDE.format('12x', 'BAD', 'NIL')}{WIDE.format('7', '', 'na')}<tr><td>few</td></tr></table>"
    closed = f"<table>{CLOSED.format('0410001', 'GONE SCHOOL', 'DisAffiliated')}{CLOSED.format('XXXXXXX', 'TEST SCHOOL DEMO', 'x')}</table>"
    rows = R.list_rows(pages(spark, wide, closed, None, "", "<p>no table", "<table><tr><td>unclosed"), "page", "html").orderBy("page", "row_ix").collect()
    assert [(r.page, r.layout, r.affiliation_no, r.skipped) for r in rows] == [(0, "state_wise", "330801", False), (0, "state_wise", "12x", True), (0, "state_wise", "7", True), (1, "closed", "0410001", False), (1, "closed", "XXXXXXX", True)]
    one, gone = rows[0], rows[3]
    assert (one.school_code, one.name, one.state, one.district, one.principal_name, one.address, one.website, one.has_class_12) == ("45", "ONE SCHOOL", "KARNATAKA", "BANGALORE URBAN", "A B", "1 ROAD BANGALORE KARNATAKA", "www.one.in", True)
    assert (gone.name, gone.state, gone.status, gone.affiliation_status, gone.region, gone.address, gone.has_class_12) == ("GONE SCHOOL", "DELHI", "Secondary Level", "DisAffiliated", "R1", None, False)
    assert rows[1].website is None and rows[1].excerpt.startswith("1 | Aff. No. : 12x")
    claims = {(c.entity_key, c.field): (c.value, c.evidence) for c in R.list_claims(R.list_rows(pages(spark, wide, closed), "page", "html")).collect()}
    assert claims["cbse:0410001", "status"] == ("disaffiliated", "Affiliation Status: DisAffiliated") and claims["cbse:330801", "has_class_12"] == ("true", "Status: Senior Secondary Level")
    assert ("cbse:330801", "status") not in claims and not any(k == "cbse:7" for k, _ in claims)


@pytest.mark.parametrize(("html", "want"), [
    ("Total No. of Schools affiliated with CBSE : 31,999 Total No Of DisAffiliated Schools : 1,847", 1847),
    ("Total No Of Schools : 12 then Total No. of Schools affiliated with CBSE : 31,999", 12),
    ("Total No. of Schools affiliated with CBSE : 31,999", 31999), ("nothing", None), (None, None), ("", None),
])
def test_stated_totals(spark, html, want):
    assert pages(spark, html).select(R.stated_total(F.col("html")).alias("n")).first().n == want


def test_the_guard_raises_where_a_page_does_not_add_up(spark):
    row = WIDE.format("1", "A", "") + WIDE.format("x", "B", "")
    good = f"Total No Of Schools : 2<table>{row}</table>"
    assert [tuple(r) for r in R.guarded_totals(pages(spark, good), "page", "html").collect()] == [(0, 1, 1, 2)]
    for bad in (f"Total No Of Schools : 3<table>{row}</table>", f"<table>{row}</table>", "Total No Of Schools : 1", None):
        with pytest.raises(Exception, match="rows of 0 are not as many as stated"):
            R.guarded_totals(pages(spark, bad), "page", "html").collect()


def card(head="AN001 - Don Bosco School", badges="<span>ICSE</span><span>ISC</span>", site="<div class='text-end'><a href=' https://d.in '>go</a></div>"):
    return f"<div class='col school-card'><div class='top-right-badges'><span>Co-ed.</span><span>Day</span><span>New</span></div><h6>{head}</h6><div class='school-badges'>{badges}</div><p>Fr. B C<br>Junglighat, Port Blair,<br> South Andaman, Andaman and Nicobar Islands, 744 103, India</p><p>other</p>{site}</div>"


def test_cards(spark):
    html = "Showing 1 to 10 of 1,928 entries" + card() + card("XX1", "<span>ICSE</span>", "") + card("TS9 - B", "<span>ICSE</span><span>x</span>", "<a href='no'>n</a>") + "<div class='school-card'></div>"
    rows = R.cards(pages(spark, html, None, "<div class=school-card>"), "page", "html").orderBy("page", "card_ix").collect()
    a, b, c, d, e = rows
    assert (a.code, a.name, a.affiliations, a.principal_name, a.gender, a.residential, a.website, a.has_class_12, a.skipped) == ("AN001", "Don Bosco School", ["ICSE", "ISC"], "Fr. B C", "Co-ed.", "Day", "https://d.in", True, False)
    assert (a.address, a.district, a.state, a.pincode, a.country) == ("Junglighat", "Port Blair South Andaman", "Andaman and Nicobar Islands", "744103", "India")  # a line loses its comma at the end
    assert (b.skipped, b.code, b.excerpt[:6]) == (True, None, "Co-ed.") and (c.code, c.website, c.has_class_12, c.skipped) == ("TS9", None, False, False)
    assert d.skipped and e.skipped and (d.name, d.principal_name, d.affiliations) == (None, None, [])
    assert pages(spark, html, "of <b>12</b> rows", None).select(R.card_total(F.col("html")).alias("n")).collect() == [(1928,), (12,), (None,)]
    claims = {(x.entity_key, x.field): x.value for x in R.card_claims(R.cards(pages(spark, html), "page", "html")).collect()}
    assert claims["cisce:AN001", "grade_high"] == "12" and claims["cisce:TS9", "has_class_12"] == "false" and ("cisce:TS9", "grade_high") not in claims


def test_details(spark):
    html = "<table><tr><td>Name of Institution:</td><td> A  SCHOOL </td></tr><tr><td>Gender</td><td>Female</td></tr><tr><td>State</td><td></td></tr><tr><td>Status of the School</td><td>Secondary Level</td></tr><tr><td>Affiliation Period</td><td>From: 01/04/2020 <b>To</b> 31/03/2025</td></tr></table>"
    got = {(c.page, c.field): (c.value, c.evidence) for c in R.detail_claims(pages(spark, html, None, "<p>"), "page", "html").collect()}
    assert got == {
        (0, "name"): ("A SCHOOL", "Name of Institution:: A SCHOOL"), (0, "grade_high"): ("Secondary Level", "Status of the School: Secondary Level"), (0, "has_class_12"): ("false", "Status of the School: Secondary Level"),
        (0, "board_valid_from"): ("01/04/2020", "Affiliation Period: From 01/04/2020 To 31/03/2025"), (0, "board_valid_to"): ("31/03/2025", "Affiliation Period: From 01/04/2020 To 31/03/2025"),
    }
