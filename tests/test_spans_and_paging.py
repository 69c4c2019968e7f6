"""Names after labels by regular expressions, addresses by the standard library, pages joined against the whole order."""

import random
from urllib.parse import quote, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from claimspark.functions import spans
from claimspark.operators import paging


def names(spark, *texts):
    return [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", spans.name_after_label(F.col("t")).alias("p")).orderBy("i").collect()]


def test_names_and_where_they_stand(spark):
    texts = ["\U0001f600 The  Principal: Dr. Ravi   Kumar, M.Sc.", "x" * 9000 + " Head of the School - Mrs Mira Sen"]
    for text, got, name in zip(texts, names(spark, *texts), ("ravi kumar", "mira sen"), strict=True):
        assert got.name == name and text[got.start : got.start + len(got.given)] == got.given and got.given.split()[-1] in got.evidence and len(got.evidence) <= 120 + len(got.given)


def test_no_name_rather_than_a_wrong_one(spark):
    texts = ["Principal's Desk Message", "PRINCIPAL QUALIFICATION Msc, B.Ed", "principal in lower case", "no label Ravi Kumar", "Principal", "", None, "Principal: Dr. Smt. of", "Principal's desk. Principal: Ravi Kumar", "Principal " + "." * 120 + " Ravi Kumar"]
    assert names(spark, *texts) == [None] * len(texts)


def test_addresses_as_the_standard_library_has_them(spark):
    r = random.Random(2)
    urls = ["https://www.tosss.edu.in/pdf/md/C1.FEE STRUCTURE.pdf", "https://school.edu.in/mandatory-disclosure?year=2025", "HTTP://a.in", "http://a.in/?", " http://a.in/x#y z", "/docs/a b", "a\tb/c\nd"]
    urls += ["https://u@h.in:80/" + "".join(r.choice("ab/ %:@?=&+éह\U0001f600~'\"$[]!#") for _ in range(r.randrange(30))) for _ in range(300)]
    got = [x.n for x in spark.createDataFrame(list(enumerate(urls)), "i int, u string").select("i", spans.normal_url(F.col("u")).alias("n")).orderBy("i").collect()]
    for url, normal in zip(urls, got, strict=True):
        p = urlsplit(url)
        assert normal == urlunsplit((p.scheme, p.netloc, quote(p.path, safe="/%:@"), quote(p.query, safe="=&%?+"), "")), url
    assert spark.range(1).select(spans.normal_url(F.lit(None).cast("string")).alias("n")).first().n is None


def test_pages_joined_are_the_whole_order(spark):
    columns = ["fit", "confidence", "fee_annual_inr_min", "fee_annual_inr_max", "pcm_12_count", "class_12_total", "total_enrollment"]
    r = random.Random(1)
    rows = [(i, *[r.choice([None, 1, 2, 3]) for _ in columns]) for i in range(23)]
    table = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} long" for c in columns)).cache()
    fee = lambda x: (x[3] + x[4]) / 2 if None not in (x[3], x[4]) else x[3] if x[3] is not None else x[4]
    for sort, value in (("fee", fee), ("pcm_12", lambda x: x[5]), ("fit", lambda x: x[1])):
        for descending in (True, False):
            sign = -1 if descending else 1
            want = [x[0] for x in sorted(rows, key=lambda x: (value(x) is None, sign * (value(x) or 0), x[0]))]
            got, after = [], None
            while True:
                shown = paging.page(table, sort, 5, descending=descending, after=after)
                ids = [x.id for x in shown.collect()]
                if not ids:
                    break
                got += ids
                after = paging.token(shown, descending=descending)
            assert got == want and paging.token(shown) is None
    with pytest.raises(ValueError, match="no sort students"):
        paging.page(table, "students", 5)
