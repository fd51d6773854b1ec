import pytest
from pyspark.sql import functions as F

from jobweft.functions import classify, places, salary, text, windows
from jobweft.plans.search import Filters, listed


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("Internship - Full Time", "Internship"), ("Permanent - Part Time", "Part-time"), ("temps plein", "Full-time"), ("full_time", "Full-time"), ("PRN", "Temporary"), ("B2B", "Contract"), ("other", None), ("", None), (None, None)])
def test_employment(spark, raw, want):
    assert one(spark, classify.employment_type(F.col("v")), v=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("hybrid remote", "Hybrid"), ("on_site", "Onsite"), ("unspecified", None), ("éremote", "Remote")])
def test_workplace(spark, raw, want):
    assert one(spark, classify.workplace_type(F.col("v")), v=raw) == want


@pytest.mark.parametrize(("title", "want"), [("Account Executive", "mid"), ("HR Business Partner", "mid"), ("Executive Assistant", "entry"), ("Sales Intern", "internship"), ("Senior Manager", "senior"), ("Associate Director", "entry"), ("Software Engineer II", "mid"), ("Baker", None)])
def test_level(spark, title, want):
    assert one(spark, classify.experience_level(F.col("v"), F.lit(None).cast("string")), v=title) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("$120,000 - $180,000", (120000, 180000, "USD", "yearly")), ("£50k-£70k", (50000, 70000, "GBP", "yearly")), ("$22 - $28/hr", (22, 28, "USD", "hourly")),
    ("Minimum Salary: 53,000 USD Maximum Salary: 80,000 USD", (53000, 80000, "USD", "yearly")), ("Base salary of $120,000", (120000, 120000, "USD", "yearly")), ("$5 - $9", None), ("", None), (None, None)])
def test_salary(spark, raw, want):
    got = one(spark, salary.salary_in_text(F.col("v")), v=raw)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("raw", "want"), [("London, England, GB, GB", ["gb"]), ("Navi Mumbai, Maharashtra, IN, IN", ["in"]), ("Wilmington, DE", []), ("Berlin, DE", []), ("Toronto, ON, CA", ["ca"]), ("Indianapolis, IN, US", ["us"]), ("Remote - U.S.", ["us"]), ("Jersey City, NJ", ["je"])])
def test_countries(spark, raw, want):
    df = spark.createDataFrame([(1, raw)], "id int, l string")
    assert sorted(r["country"] for r in places.with_countries(df, "l", "id").collect()) == want


@pytest.mark.parametrize(("raw", "want"), [("London, England, GB, GB", ["london", "england", "gb"]), ("San Francisco, CA, US", ["san francisco", "san", "francisco", "ca", "us"]), (None, [])])
def test_tokens(spark, raw, want):
    assert one(spark, places.location_tokens(F.col("v")), v=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("7d", 604800), ("7 days", 604800), ("last_24h", 86400), ("last_week", 604800), ("past-week", 604800), ("3m", 7776000), ("0d", None), ("abc", None), ("", None)])
def test_window(raw, want):
    w = windows.parse_window(raw)
    assert (w.seconds if w else None) == want


def test_text_functions(spark):
    assert one(spark, text.strip_html(F.col("v")), v="<p>a &amp;lt; b</p><ul><li>x</li></ul>") == "a < b\n\n• x"
    assert one(spark, text.registrable_domain(F.col("v")), v="careers.shop.co.uk") == "shop.co.uk"
    assert one(spark, text.registrable_domain(F.col("v")), v="a.b.example.com") == "example.com"
    assert one(spark, text.redirected_off(F.col("a"), F.col("b")), a="https://x.example/jobs/abc12345", b="https://x.example/jobs") is True
    assert one(spark, text.demand_key(*[F.col(c) for c in "abcde"]), a=" Data  Engineer", b=None, c="Full-time", d="", e="remote") == "data engineer||full-time||remote"


def test_filter_lists(spark):
    assert listed(" a, A ,b,,") == ["a", "b"] and listed(None) == []
    assert Filters(employment_type="nonsense").condition() is not None


@pytest.mark.parametrize(("title", "location", "description", "want"), [
    ("Engineer", "Worldwide", None, True), ("Engineer", "Anywhere in Europe", None, False), ("Engineer", "anywhere in the world", None, True), ("Engineer - US", "Anywhere", None, False), ("Engineer", "Anywhere us", None, False),
    ("Driver", "Anywhere", None, False), ("Engineer", None, "Work from anywhere you like", True), ("Engineer", None, "work from anywhere, must be based in Peru", False), ("Engineer", "Lima", "work from anywhere", False), ("Engineer", None, None, False)])
def test_worldwide(spark, title, location, description, want):
    assert one(spark, classify.is_worldwide(F.col("a"), F.col("b"), F.col("c"), F.lit(True)), a=title, b=location, c=description) is want
