from pyspark.sql import functions as F

from claimspark.functions import identity as I
from claimspark.sources import pages as P

PAGE = """<nav><a href="/nav/mandatory-public">Menu</a><table><tr><td>menu</td></tr></table></nav><table><tr><th>S.No</th><th>Item</th><th>Detail</th></tr><tr><td>1.</td><td>PIN code</td><td>560 001</td></tr></table>
<p>x</p><table><tr><td>Tuition <b>Fee</b> Structure<td>1000</tr><tr><td>Student Name</td><td>Marks</td></tr></table>
<a href="/docs/long-disclosure.pdf">x</a><a href="about">About</a><a href="m">Mandatory list</a><a href="m">Mandatory list</a><a href="mailto:mandatory@x.y">z</a><a href="http://[bad">disclosure</a>"""


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).cast("string" if v is None or isinstance(v, str) else "double").alias(k) for k, v in values.items()]).select(column).first()[0]


def test_persons_titles_domains(spark):
    person = lambda x: one(spark, I.normalize_person(F.col("x")), x=x)
    assert person("Dr. A.B. Sharma") == person("A B Sharma") == "a b sharma"
    assert person("Dr.") is None and person(None) is None
    title = lambda x: one(spark, I.normalize_title(F.col("x")), x=x)
    assert [title(x) for x in ("Vice Principal", "The Principal", "Executive Director", "Peon", None)] == ["vice_principal", "principal", "director", "other", "other"]
    domain = lambda x: one(spark, I.registrable_domain(F.col("x")), x=x)
    assert [domain(x) for x in ("http://one.two.ac.in/x", "https://u@www.a.com:8/y", "http://localhost/")] == ["two.ac.in", "a.com", "localhost"]
    token = lambda x: one(spark, I.registrable_token(F.col("x")), x=x)
    assert [token(x) for x in ("www.lotusvale.com", "https://northridgehall.ac.in/", "www.hillsidepark/in", "riverbendhall@.in", "x.wixsite.com", "123456.com", "", None)] == ["lotusvale", "northridgehall", "hillsidepark", "riverbendhall", None, None, None, None]


def test_years_pins_agreement_and_map(spark):
    assert [one(spark, I.fee_year(F.col("x")), x=x) for x in ("ACADEMICYEAR2024-25", "2024/2025", "2024", None)] == [2024, 2024, None, None]
    assert [one(spark, I.pin_near(F.col("x")), x=x) for x in ("Pin code: 560001", "830887", None)] == ["560001", None, None]
    agree = lambda e, a: one(spark, I.values_agree(F.col("e"), F.col("a"), 0.05), e=e, a=a)
    assert [agree("185000", x) for x in ("190000", "194000", "195000", "18500", None, "x")] == [True, True, False, False, False, False]
    assert one(spark, I.values_agree(F.col("e"), F.col("a")), e=" Yes", a="yes ") is True
    assert tuple(one(spark, I.map_point(F.col("a"), F.col("b")), a=37.5, b=97.5)) == (760.0, 0.0)
    assert one(spark, I.bubble_radius(F.col("a"), F.col("b")), a=5.0, b=5.0) == 40.0 and one(spark, I.bubble_radius(F.col("a"), F.col("b")), a=0.0, b=5.0) == 4.0
    assert [one(spark, I.estimated_enrollment(F.col("x")), x=x) for x in (2.0, 3.0, 501.0)] == [None, 75.0, None]


def test_tables_links_and_kinds(spark):
    pages = spark.createDataFrame([(1, PAGE, "http://a.in"), (2, None, None), (3, "<table><tr><td>a", "http://b.in")], "id int, html string, base string")
    rows = P.html_tables(pages, "id", "html")
    assert [tuple(r) for r in rows.orderBy("id", "table_ix", "row_ix").collect()] == [
        (1, 0, 0, ["S.No", "Item", "Detail"]), (1, 0, 1, ["1.", "PIN code", "560 001"]), (1, 1, 0, ["Tuition Fee Structure", "1000"]), (1, 1, 1, ["Student Name", "Marks"]), (3, 0, 0, ["a"]),
    ]
    kinds = {(r.id, r.table_ix): (r.is_fee, r.is_result, r.student_data) for r in P.table_kinds(rows, "id", ["fee structure"], ["pass percentage"]).collect()}
    assert kinds == {(1, 0): (False, False, False), (1, 1): (True, False, True), (3, 0): (False, False, False)}
    assert tuple(P.labelled_value(rows, "id", ["pin code"]).first()) == (1, "560 001", "1. PIN code 560 001")
    links = P.disclosure_links(P.html_links(pages, "id", "html", "base"), "id").orderBy("place").collect()
    assert [r.url for r in links] == ["http://a.in/docs/long-disclosure.pdf", "http://a.in/m", "http://a.in/nav/mandatory-public"]


def test_page_classes(spark):
    rows = spark.createDataFrame([("Just a moment...", ""), ("x" * 5000 + "captcha_resp", None), ("ok", "challenge"), (None, None)], "body string, header string")
    assert [r[0] for r in rows.select(P.is_interstitial(F.col("body"), F.col("header"))).collect()] == [True, False, True, False]
    texts = spark.createDataFrame([("Fee and affiliation, sign in",), ("Parent portal sign in",), ("news",)], "t string")
    assert [tuple(r) for r in texts.select(P.is_disclosure_page(F.col("t")), P.is_login_wall(F.col("t"))).collect()] == [(True, False), (False, True), (False, False)]
