import pytest
from pyspark.sql import functions as F

from jobweft.functions import names, places
from jobweft.operators import matching
from jobweft.sources import pages


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]
    return row


def test_embedded(spark):
    assert one(spark, pages.hidden_json(F.col("h"), "jobs"), h='<input value="{&quot;a&quot;:1}" type="hidden" id="jobs">') == '{"a":1}'
    assert one(spark, pages.repaired_json(pages.script_json(F.col("h"))), h=r"""var jobs = JSON.parse('[{\x22d\x22: \x222026\-04\x22}]')""") == '[{"d": "2026-04"}]'
    assert one(spark, pages.unescaped(F.col("h")), h="&#8364;&eacute;") == "€é"
    assert one(spark, pages.balanced_div(F.col("h"), F.lit("body")), h='<div class="x body y">a<div>b</div>c</div><div>d</div>') == "a<div>b</div>c"
    assert one(spark, pages.balanced_div(F.col("h"), F.lit("body")), h=None) is None
    assert one(spark, pages.microdata(F.col("h"), "datePosted"), h='<meta content="2024-01-02" itemprop="datePosted">') == "2024-01-02"
    assert one(spark, pages.packed_fields(F.col("h")), h="a!|!!*!b%20c!|!") == ["a", "b c", ""]


def test_pairs(spark):
    html = "<dt>Job <b>Location</b></dt><dd>Oslo</dd><dt>Minimum Salary</dt><dd>53,000 USD</dd><dt>x</dt><dd></dd><dt>job location</dt><dd>Bergen</dd>"
    pairs = pages.labelled_pairs(F.col("h"))
    assert one(spark, pairs, h=html) == {"minimum salary": "53,000 USD", "job location": "Bergen"}
    assert one(spark, pages.value_like(pairs, "location"), h=html) == "Bergen"
    assert tuple(one(spark, pages.flex_pay(pairs), h=html)) == (53000.0, None, "USD") and one(spark, pages.flex_pay(pairs), h="") is None


def test_sitemaps_and_details(spark):
    rows = [("s", "i", "<sitemapindex><loc>m1</loc><loc> m2 </loc></sitemapindex>"), ("s", "m1", "<urlset><loc>/job/1?a&amp;b</loc><loc>/about</loc></urlset>"), ("s", "other", "<urlset><loc>/job/9</loc></urlset>"), ("t", "x", "<urlset><loc>/job/2</loc></urlset>")]
    got = {tuple(r) for r in pages.sitemap_postings(spark.createDataFrame(rows, "slug string, url string, payload string"), "/job/").collect()}
    assert got == {("s", "/job/1?a&b"), ("t", "/job/2")}
    a = spark.createDataFrame([(1, "t", None), (2, "u", "x")], "id int, title string, place string")
    b = spark.createDataFrame([(1, "p", "d"), (1, "p", "d")], "id int, place string, description string")
    assert sorted(tuple(r) for r in pages.with_details(a, b, "id").collect()) == [(1, "t", "p", "d"), (2, "u", "x", None)]


def test_small_functions(spark):
    assert one(spark, pages.most_specific(F.col("a")), a=["India", "Pune, Maharashtra, India", "A, B, C"]) == "Pune, Maharashtra, India"
    assert tuple(one(spark, pages.dollar_range(F.col("t")), t="pays $50,000 - $70,500.50 a year")) == (50000, 70500) and one(spark, pages.dollar_range(F.col("t")), t="$5 - $9") is None
    assert one(spark, pages.structured_workplace(F.col("a"), F.lit(None), F.lit(None)), a="Not remote") == "onsite"
    assert one(spark, pages.structured_workplace(F.col("a"), F.lit(None), F.lit(None)), a="Hybrid Remote") == "hybrid"
    good = '```json\n{"is_remote": true, "remote_worldwide": false, "visa_sponsorship": "unknown", "experience_level": "mid"}\n```'
    assert tuple(one(spark, pages.model_answer(F.col("t")), t=good)) == (True, False, None, "mid")
    assert one(spark, pages.model_answer(F.col("t")), t=good.replace("mid", "boss")) is None and one(spark, pages.model_answer(F.col("t")), t="no json") is None
    anchors, marks = F.expr("array(named_struct('at', 5, 'value', 'A'), named_struct('at', 20, 'value', 'B'))"), F.expr("array(named_struct('at', 2, 'value', 'x'), named_struct('at', 3, 'value', 'y'))")
    assert [tuple(r) for r in one(spark, pages.between_anchors(anchors, marks), t="")] == [("A", "y"), ("B", None)]


@pytest.mark.parametrize(("url", "want"), [
    ("https://acme.wd5.myworkdayjobs.com/en-US/Site/job/Oslo/Cook_R1", ("workday", "acme", "Site", "/job/Oslo/Cook_R1")), ("https://wd3.myworkdaysite.com/recruiting/acme/Site/job/X_1", ("workday", "acme", "Site", "/job/X_1")),
    ("https://eabc.fa.em2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/requisitions/job/300", ("oracle", "eabc", "CX_1", "300")), ("https://eabc.fa.oraclecloud.com/sites/CX/job/12", ("oracle", "eabc", "CX", "12")),
    ("https://evil.example/job/1", None), ("not a url", None)])
def test_vendor_postings(spark, url, want):
    got = one(spark, pages.vendor_posting(F.col("u")), u=url)
    assert (got and (got["vendor"], got["tenant"], got["site"], got["id"])) == want


def test_names(spark):
    assert one(spark, names.slug_candidates(F.col("n"), F.col("d")), n="Blue Origin, Inc.", d="careers.blueorigin.co.uk") == ["blueorigin", "blue-origin"]
    assert one(spark, names.is_acronym(F.lit("mtc"), F.col("n")), n="Management and Training Corporation") is True
    assert one(spark, names.one_employer(F.col("a")), a=["MTC", "Management and Training Corporation"]) is True
    assert one(spark, names.one_employer(F.col("a")), a=["Acme", "Beta"]) is False and one(spark, names.one_employer(F.col("a")), a=["", "Acme Inc"]) is True
    assert one(spark, names.board_address(F.lit("lever"), F.col("s")), s="acme") == "https://jobs.lever.co/acme" and one(spark, names.board_address(F.lit("?"), F.col("s")), s="acme") == "https://acme.com/careers"
    for url, want in (("https://a.example/x", True), ("http://a.example", False), ("https://10.0.0.1/", False), ("https://x.internal/", False), ("https://localhost/", False), (None, False)):
        assert one(spark, names.public_https(F.col("u")), u=url) is want
    assert one(spark, names.image_type(F.col("b")), b=b"\x89PNG\r\n") == "image/png" and one(spark, names.image_type(F.col("b")), b=b"  <svg/>") == "image/svg+xml" and one(spark, names.image_type(F.col("b")), b=b"\xff\xfe\x00") is None
    assert one(spark, names.truncated_bytes(F.col("t"), 5), t="aé日b") == "aé" and one(spark, names.truncated_bytes(F.col("t"), 50), t="aé日b") == "aé日b"
    assert one(spark, names.rotated(F.col("a"), F.lit(-1)), a=["x", "y", "z"]) == ["z", "x", "y"] and one(spark, names.rotated(F.col("a"), F.lit(5)), a=[]) == []


def test_regions(spark):
    assert places.region_codes("“DACH”") == ["de", "at", "ch"] and places.region_codes("Berlin") == [] and places.resolve_country(spark, " U.K. ") == "gb"
    df = spark.createDataFrame([(1, "Berlin, Germany"), (2, "Zurich, CH, CH"), (3, "Berlin Heights, OH, US")], "id int, location string")
    assert sorted(r["id"] for r in places.place_filter(df, "dach").collect()) == [1, 2]
    assert sorted(r["id"] for r in places.place_filter(df, "berlin").collect()) == [1, 3]


def test_nearest_before_without_marks(spark):
    points = spark.createDataFrame([(1, 5, "p"), (2, 1, "q")], "k int, t int, p string")
    marks = spark.createDataFrame([(1, 5, 10), (1, 9, 11)], "k int, t int, m int")
    assert sorted((r["p"], r["near_m"], r["near_at"]) for r in matching.nearest_before(points, marks, "k", "t", "m").collect()) == [("p", 10, 5), ("q", None, None)]
