"""Parsers of landed payloads and functions of texts as queries over small literal frames, each with the rows worked out by hand.

The payloads stand in for landed tables, which the test tables lack. The SQL states the rows expected, so
that nothing of the code under test is in it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweft.functions import classify, liveness, names, places, text, windows
from jobweft.schemas import SNAPSHOT_FIELDS
from jobweft.sources import boards, feeds, files, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _value(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


def rows_sql(columns: list[str], rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) t({', '.join(columns)})"


def case(name: str, columns: list[str], rows: list[tuple], build: Callable[[SparkSession], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: build(spark).select(*columns)
    SQL[name] = rows_sql(columns, rows)


def landed(spark: SparkSession, *payloads, slug: str = "acme") -> DataFrame:
    """A landed frame: each payload, and besides one that is no feed and one that is null."""
    rows = [(slug, p if isinstance(p, str) else json.dumps(p)) for p in payloads]
    return spark.createDataFrame([*rows, ("bad", "<html>"), ("none", None)], "slug string, payload string")


def detailed(spark: SparkSession, *rows, slug: str = "acme") -> DataFrame:
    return spark.createDataFrame([(slug, i, p if isinstance(p, str) else json.dumps(p)) for i, p in rows], "slug string, id string, payload string")


def melted(d: DataFrame, *more: str) -> DataFrame:
    """(external_id, field, value) of the fields that are filled."""
    named = [n for n in SNAPSHOT_FIELDS if n not in ("external_id", "raw_data")] + list(more)
    return d.select("external_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in named])).alias("e")).select("external_id", "e.*").where("value IS NOT NULL")


def feed(name: str, expected: dict[str, dict[str, str]], build: Callable[[SparkSession], DataFrame], *more: str) -> None:
    rows = [(i, f, v) for i, fields in expected.items() for f, v in fields.items()]
    case(f"feed_{name}", ["external_id", "field", "value"], rows, lambda spark: melted(build(spark), *more))


def shown(c: Column) -> Column:
    """A value as text: structs and arrays as JSON."""
    return F.get_json_object(F.to_json(F.struct(c.alias("v"))), "$.v")


def function(name: str, schema: str, inputs: list[tuple], expected: list[str | None], of: Callable[..., Column]) -> None:
    """Query case_name with rows (n, out): the function on each input, as text."""

    def build(spark: SparkSession) -> DataFrame:
        d = spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], f"_case int, {schema}")
        return d.select("_case", shown(of(*[F.col(a) for a in d.columns[1:]])).alias("out")).withColumnRenamed("_case", "n")

    case(f"case_{name}", ["n", "out"], list(enumerate(expected)), build)


# feeds

feed("greenhouse", {
    "greenhouse_7": {"title": "Nurse", "department": "Care", "location": "Oslo", "description": "<p>x</p>", "url": "https://b/7", "posted_at": "2024-01-02"},
    "greenhouse_8": {"title": "Cook", "location": "Remote", "posted_at": "2024-03-04"},
}, lambda s: feeds.parse_feed(landed(s, {"jobs": [
    {"id": 7, "title": "Nurse", "departments": [{"name": "Care"}, {"name": "Other"}], "location": {"name": "Oslo"}, "content": "<p>x</p>", "absolute_url": "https://b/7", "first_published": "2024-01-02", "updated_at": "2024-02-02"},
    {"id": 8, "title": "Cook", "departments": [], "location": None, "updated_at": "2024-03-04"}, {"title": "no id"}]}), "greenhouse"))
feed("ashby", {
    "ashby_a": {"title": "Dev", "department": "R&D", "location": "Bonn", "workplace_type": "Hybrid", "employment_type": "FullTime", "salary_min": "50", "salary_max": "70", "salary_currency": "EUR", "salary_interval": "1 YEAR", "description": "<b>h</b>", "url": "u", "posted_at": "2024-05-06"},
    "ashby_b": {"title": "Ops", "workplace_type": "Remote", "description": "plain"},
}, lambda s: feeds.parse_feed(landed(s, {"jobs": [
    {"id": "a", "title": "Dev", "department": "R&D", "location": "Bonn", "workplaceType": "Hybrid", "isRemote": True, "employmentType": "FullTime", "descriptionHtml": "<b>h</b>", "descriptionPlain": "h", "jobUrl": "u", "publishedAt": "2024-05-06",
     "compensation": {"summaryComponents": [{"minValue": 50, "maxValue": 70, "currencyCode": "EUR", "interval": "1 YEAR"}, {"minValue": 1}]}},
    {"id": "b", "title": "Ops", "isRemote": True, "descriptionHtml": "", "descriptionPlain": "plain"}]}), "ashby"))
feed("lever", {
    "lever_x": {"title": "T", "department": "A", "location": "B", "employment_type": "Full", "salary_min": "1", "salary_max": "2", "salary_currency": "USD", "salary_interval": "year", "description": "d\n\nL:\nc\n\ne", "url": "h", "posted_at": "2024-02-02T07:23:06.472Z"},
    "lever_y": {"title": "U", "department": "D", "location": "Remote"},
}, lambda s: feeds.parse_feed(landed(s, [
    {"id": "x", "text": "T", "categories": {"team": "A", "department": "D", "location": "B", "commitment": "Full"}, "salaryRange": {"min": 1, "max": 2, "currency": "USD", "interval": "year"}, "createdAt": 1706858586472,
     "descriptionPlain": "d", "description": "<d>", "lists": [{"text": "L", "content": "c"}, {"text": "", "content": "c"}], "additional": "e", "hostedUrl": "h"},
    {"id": "y", "text": "U", "categories": {"department": "D", "location": ""}}]), "lever"))
feed("workable", {
    "workable_S": {"title": "T", "department": "D", "location": "C, K", "workplace_type": "Remote", "employment_type": "Full-time", "url": "https://apply.workable.com/acme/j/S/", "posted_at": "2024"},
    "workable_R": {"title": "U", "location": "Remote", "workplace_type": "on_site", "employment_type": "other", "url": "https://apply.workable.com/acme/j/R/"},
}, lambda s: feeds.parse_feed(landed(s, {"results": [
    {"shortcode": "S", "title": "T", "department": ["D"], "location": {"city": "C", "region": None, "country": "K"}, "remote": True, "workplace": "hybrid", "type": "full", "published": "2024"},
    {"shortcode": "R", "title": "U", "location": {}, "workplace": "on_site", "type": "other"}]}), "workable"))
feed("recruitee", {
    "recruitee_1": {"title": "T", "location": "City, Land", "workplace_type": "hybrid", "salary_min": "1", "salary_max": "2", "salary_currency": "EUR", "salary_interval": "year", "url": "https://acme.recruitee.com/o/1"},
    "recruitee_2": {"title": "U", "location": "L", "workplace_type": "remote", "url": "c"},
}, lambda s: feeds.parse_feed(landed(s, {"offers": [
    {"id": 1, "title": "T", "city": "City", "country": "Land", "hybrid": True, "on_site": True, "salary": {"min": 1, "max": 2, "currency": "EUR", "period": "year"}}, {"id": 2, "title": "U", "location": "L", "remote": True, "hybrid": True, "careers_url": "c"}]}), "recruitee"))
feed("smartrecruiters", {
    "smartrecruiters_1": {"title": "T", "department": "D", "location": "X", "workplace_type": "remote", "employment_type": "Full", "salary_min": "60000", "salary_max": "90000", "salary_currency": "USD", "description": "a $60,000 - $90,000.50\nb", "url": "p", "posted_at": "2024"},
    "smartrecruiters_2": {"title": "U", "location": "Remote", "workplace_type": "hybrid", "url": "https://jobs.smartrecruiters.com/acme/2"},
}, lambda s: boards.smartrecruiters_details(feeds.parse_feed(landed(s, {"content": [
    {"id": "1", "name": "T", "department": {"label": "D"}, "location": {"city": "X", "remote": True, "hybrid": True}, "typeOfEmployment": {"label": "Full"}, "releasedDate": "2024"}, {"id": "2", "name": "U", "location": {"hybrid": True}}]}), "smartrecruiters"),
    detailed(s, ("1", {"postingUrl": "p", "jobAd": {"sections": {"a": {"text": "a $60,000 - $90,000.50"}, "n": {"text": ""}, "b": {"text": "b"}}}}), ("1", {"postingUrl": "p", "jobAd": {"sections": {"a": {"text": "a $60,000 - $90,000.50"}, "n": {"text": ""}, "b": {"text": "b"}}}}))))
feed("rippling", {
    "rippling_a": {"title": "A", "department": "D", "location": "Remote (US)", "workplace_type": "remote", "description": "firm\npay", "url": "https://ats.rippling.com/acme/jobs/a"},
    "rippling_b": {"title": "B", "location": "Remote", "url": "u"},
}, lambda s: boards.rippling_details(feeds.parse_feed(landed(s, {"0": {"uuid": "a", "name": "A", "department": {"label": "D"}, "workLocation": {"label": "Remote (US)"}}, "1": {"uuid": "b", "name": "B", "url": "u"}}), "rippling"),
    detailed(s, ("a", {"description": {"company": "firm", "role": "", "compensation": "pay"}}))))
feed("personio", {
    "personio_5": {"title": "N", "department": "D", "location": "Remote", "employment_type": "full-time", "description": "<h3>H</h3><p>x</p>\n<h3>I</h3>y", "url": "https://acme.jobs.personio.de/job/5?language=en", "posted_at": "2024"},
}, lambda s: feeds.parse_positions_xml(landed(s, "<position><id>5</id><name>N</name><department>D</department><schedule>full-time</schedule><createdAt>2024</createdAt><jobDescription><name>H</name><value><![CDATA[<p>x</p>]]></value></jobDescription>"
    "<jobDescription><name> I </name><value> <![CDATA[y]]> </value></jobDescription><jobDescription><name>E</name><value><![CDATA[ ]]></value></jobDescription></position><position><name>no id</name></position>")))
feed("breezy", {
    "breezy_f": {"title": "T", "location": "C", "workplace_type": "remote", "employment_type": "Full", "salary_min": "90000", "salary_max": "120000", "salary_currency": "USD", "salary_interval": "year", "url": "https://acme.breezy.hr/p/f"},
}, lambda s: feeds.parse_feed(landed(s, [{"friendly_id": "f", "name": "T", "location": {"name": "", "city": "C", "is_remote": True}, "type": {"name": "Full"}, "salary": "$90k - $120,000 / year"}]), "breezy"))
feed("jazzhr", {
    "jazzhr_j1": {"title": "Cook", "location": "Rome, IT", "department": "Kitchen", "url": "https://acme.applytojob.com/apply/j1/Cook"}, "jazzhr_j2": {"title": "Head Chef", "url": "https://acme.applytojob.com/apply/j2/Head-Chef?x=1"},
}, lambda s: boards.parse_jazzhr(landed(s,
    '<div class="resumator-job-title a">Cook</div> <div class="resumator-job-info"><span>Location: </span>Rome, IT <span>Department: </span>Kitchen</div><div><a href="https://acme.applytojob.com/apply/j1/Cook">x</a></div>',
    '<a href="https://acme.applytojob.com/apply/j2/Head-Chef?x=1">a</a><a href="https://acme.applytojob.com/apply/j2/Again">b</a>')))
feed("workday", {
    "workday_R-1": {"title": "T", "department": "Care", "location": "L", "url": "https://acme.wd5.myworkdayjobs.com/Site/job/X"}, "workday_/job/Y": {"title": "U", "url": "https://acme.wd5.myworkdayjobs.com/Site/job/Y"},
}, lambda s: boards.workday_departments(
    feeds.parse_feed(landed(s, {"jobPostings": [{"title": "T", "externalPath": "/job/X", "locationsText": "L", "bulletFields": ["R-1"]}, {"title": "U", "externalPath": "/job/Y"}]}, slug="acme.wd5/Site"), "workday"),
    s.createDataFrame([("acme.wd5/Site", "Care", "workday_R-1"), ("acme.wd5/Site", "Zoo", "workday_R-1"), ("other", "No", "workday_/job/Y")], "slug string, department string, external_id string")))
feed("zoho", {
    "zoho_1": {"title": "Dev / Ops", "department": "IT", "location": "Pune, India", "workplace_type": "remote", "employment_type": "Full time", "description": "short ...", "url": "https://l/1/Dev-Ops", "posted_at": "2024", "preview": "true"},
    "zoho_2": {"title": "Open", "department": "Bank", "location": "Ghana", "description": "x" * 700, "url": "https://l/2/", "preview": "false"},
}, lambda s: boards.parse_zoho(landed(s, '<input type="hidden" value="' + json.dumps([
    {"id": "1", "Posting_Title": "Dev / Ops", "City": "Pune", "Country": "India", "Remote_Job": True, "Job_Type": "Full time", "Department": "IT", "Job_Description": "short ...", "Date_Opened": "2024"},
    {"id": "2", "Job_Opening_Name": "Open", "Country1": "Ghana", "Industry": "Bank", "Job_Description": "x" * 700}, {"id": "3", "Posting_Title": "Hidden", "Publish": False}]).replace('"', "&#34;")
    + '" id="jobs"><input id="meta" value="{&#34;list_url&#34;:&#34;https://l&#34;}">')), "preview")
feed("icims", {
    "icims_12": {"title": "Lead Nurse", "department": "Care", "location": "US-TX-Austin", "employment_type": "Full", "description": "First part of it\n\nSecond part of it", "url": "https://p/jobs/12/x"},
    "icims_13": {"title": "Cook", "location": "Oslo, NO", "employment_type": "PART_TIME", "description": "By JSON", "url": "https://p/jobs/13/x"},
}, lambda s: boards.icims_details(boards.parse_icims(landed(s, '<a href="https://p/jobs/12/x" title="12 - Nurse" class="iCIMS_Anchor">n</a><a href="https://p/jobs/13/x" title="13 - Cook" class="iCIMS_Anchor">c</a><a href="https://p/jobs/12/y" title="12 - Again" class="iCIMS_Anchor">n</a>')),
    detailed(s, ("12", '<h1 class="iCIMS_Header"> Lead Nurse </h1><dt><span class="sr-only">Job Location Type</span></dt><dd class="iCIMS_JobHeaderData">On site</dd><dt>Job Locations</dt> <dd class="iCIMS_JobHeaderData"><span>US-TX-Austin</span></dd><dt>Category</dt>'
                       '<dd class="iCIMS_JobHeaderData">Care</dd><dt>Type</dt><dd class="iCIMS_JobHeaderData">Full</dd><div class="iCIMS_Expandable_Text"><p>First part of it</p></div><div class="iCIMS_Expandable_Text">tiny</div><div class="iCIMS_Expandable_Text">Second part  of it</div>'),
             ("13", '<script type="application/ld+json">{"@type":"JobPosting","description":"<p>By JSON</p>","employmentType":"PART_TIME","jobLocation":{"address":{"addressLocality":"Oslo","addressCountry":"NO"}}}</script>'))))
feed("oracle", {
    "oracle_1": {"title": "T", "department": "Org", "location": "A; B", "employment_type": "Full", "salary_min": "53000", "salary_max": "80000.5", "salary_currency": "USD", "description": "long\nmust", "posted_at": "2024"}, "oracle_2": {"title": "U", "description": "short"},
}, lambda s: boards.oracle_details(feeds.parse_feed(landed(s, {"items": [{"requisitionList": [{"Id": 1, "Title": "T", "PrimaryLocation": "A", "secondaryLocations": [{"Name": "B"}, {"Name": "A"}], "JobSchedule": "Full", "PostedDate": "2024"}]},
    {"requisitionList": [{"Id": 2, "Title": "U", "ShortDescriptionStr": "short"}]}]}), "oracle"),
    detailed(s, ("1", {"items": [{"ExternalDescriptionStr": "long", "ExternalQualificationsStr": "", "ExternalResponsibilitiesStr": "must", "Department": "", "Organization": "Org", "requisitionFlexFields": [
        {"Prompt": " Minimum Salary", "Value": "1 EUR"}, {"Prompt": "minimum salary ", "Value": "53,000 USD"}, {"Prompt": "Max Salary", "Value": "80,000.5"}, {"Prompt": "", "Value": "x"}]}]}))))
feed("bamboohr", {
    "bamboohr_4": {"title": "T", "location": "City, Land", "workplace_type": "hybrid", "salary_min": "17", "salary_currency": "USD", "salary_interval": "hour", "description": "d", "url": "s", "posted_at": "2024"},
    "bamboohr_5": {"title": "U", "department": "Remote team", "location": "Old", "workplace_type": "remote", "employment_type": "Full-Time", "url": "https://acme.bamboohr.com/careers/5"},
}, lambda s: boards.bamboohr_details(feeds.parse_feed(landed(s, {"result": [{"id": "4", "jobOpeningName": "T", "locationType": "2", "employmentStatusLabel": "Active", "location": {"city": "Old"}},
    {"id": "5", "jobOpeningName": "U", "departmentLabel": "Remote team", "employmentStatusLabel": "Full-Time", "location": {"city": "Old"}}]}), "bamboohr"),
    detailed(s, ("4", {"compensation": "$17.00 per hour", "description": "d", "location": {"city": "City", "addressCountry": "Land"}, "jobOpeningShareUrl": "s", "datePosted": "2024"}))))
feed("taleo", {
    "taleo_77": {"title": "Site Nurse", "department": "Clinical Care", "location": "UK-England-York; FR-Paris", "employment_type": "Full-time", "url": "https://acme.taleo.net/careersection/jobdetail.ftl?job=77"},
    "taleo_78": {"title": "Cook & Co", "department": "Kitchen", "url": "https://acme.taleo.net/careersection/jobdetail.ftl?job=78"},
}, lambda s: boards.parse_taleo(detailed(s, ("77", "x!|!Site Nurse!|!77!|!UK-England-York!|!a!|!FR-Paris!|!Full-time!|!12-Jan-2024!|!true!|!Clinical Care!|!Later Words"), ("78", "x!|!!*!Cook%20%26%20Co!|!78!|!Jan 5, 2024!|!Kitchen"), ("79", "nothing here"))))
feed("pinpoint", {
    "pinpoint_1": {"title": "T", "department": "D", "workplace_type": "onsite", "salary_min": "5", "description": "d\n<h3>Key Responsibilities</h3>k\n<h3>Perks</h3>b", "url": "https://acme.pinpointhq.com/postings/1", "posted_at": "2023"},
}, lambda s: feeds.parse_feed(landed(s, {"data": [{"id": 1, "title": "T", "department": {"name": "D"}, "workplace_type": "on_site", "remote": True, "compensation_minimum": 5, "description": "d", "key_responsibilities": "k", "benefits": "b", "benefits_header": "Perks", "created_at": "2023"}]}), "pinpoint"))
feed("comeet", {
    "comeet_1": {"title": "Untitled", "location": "C, S", "workplace_type": "Elsewhere", "employment_type": "Contract", "description": "d", "url": "https://www.comeet.co/jobs/U/1"}, "comeet_2": {"title": "T", "workplace_type": "hybrid", "employment_type": "Odd", "url": "u"},
}, lambda s: feeds.parse_feed(landed(s, [{"uid": "1", "name": "", "employment_type": "Freelance", "workplace_type": "Elsewhere", "location": {"city": "C", "state": "S"}, "details": {"description": "d"}},
    {"uid": "2", "name": "T", "workplace_type": "Hybrid", "employment_type": "Odd", "url_active_page": "u"}], slug="U:T:x"), "comeet"))
feed("paylocity", {"paylocity_3": {"title": "T", "department": "H", "location": "C, S", "workplace_type": "remote", "posted_at": "2024"}, "paylocity_4": {"title": "U", "location": "Place"}},
     lambda s: feeds.parse_feed(landed(s, '<script>window.pageData = {"Jobs": [{"JobId": 3, "JobTitle": "T", "HiringDepartment": "H", "JobLocation": {"City": "C", "State": "S"}, "IsRemote": true, "PublishedDate": "2024"}, {"JobId": 4, "JobTitle": "U", "LocationName": "Place"}]};</script>'), "paylocity"))
feed("teamtailor", {
    "teamtailor_g": {"title": "A & B", "department": "D", "location": "C, K", "workplace_type": "remote", "description": "<p>d</p>", "url": "l", "posted_at": "2024", "capped": "false"},
}, lambda s: feeds.parse_rss(landed(s, "<rss><item><guid>g</guid><title><![CDATA[A & B]]></title><link>l</link><description><![CDATA[<p>d</p>]]></description><pubDate>2024</pubDate><remoteStatus>fully</remoteStatus><tt:department>D</tt:department>"
    "<tt:city>C</tt:city><tt:country>K</tt:country></item><item><title>no guid</title><link>x</link></item></rss>")), "capped")
feed("jobvite", {
    "jobvite_o1": {"title": "Dev (remote)", "department": "Dev x", "location": "Pune, Maharashtra, India", "workplace_type": "remote", "salary_min": "60000", "salary_currency": "USD", "salary_interval": "year", "description": "d"},
    "jobvite_o2": {"title": "Ops", "department": "Ops", "location": "US"},
}, lambda s: boards.jobvite_details(
    (lambda d: d.select("slug", F.concat(F.lit("jobvite_"), "id").alias("external_id"), *[F.col(n) if n in ("title", "location", "department") else F.lit(None).cast("string").alias(n) for n in SNAPSHOT_FIELDS if n != "external_id"]))(
        feeds.parse_headed_listing(landed(s, "<h3>Ops</h3><a href='/j/o2'>Ops</a><i>US, us</i><h3>Dev <b>x</b></h3><a href='/j/o1'>Dev (remote)</a><i><div class='jv-meta'>2 Locations</div></i>"), link=r"(?is)<a href='/j/(\w+)'>(.*?)</a><i>(.*?)</i>")),
    detailed(s, ("o1", '<script type="application/ld+json">{"@type":"JobPosting","description":"d","jobLocation":[{"address":{"addressCountry":"India"}},{"address":{"addressLocality":"Pune","addressRegion":"Maharashtra","addressCountry":"India"}}],'
                       '"baseSalary":{"currency":"USD","value":{"minValue":"60,000","maxValue":"","unitText":"YEAR"}}}</script>'))))
feed("amazon", {"amazon_9": {"title": "T", "department": "b", "location": "L", "url": "https://www.amazon.jobs/en/jobs/9"}},
     lambda s: feeds.parse_feed(landed(s, {"jobs": [{"id_icims": "9", "id": "z", "title": " T ", "job_category": "", "business_category": "b", "location": "L", "job_path": "/en/jobs/9"}]}), "amazon"))
feed("netflix", {"netflix_3": {"title": "N", "department": "B", "location": "A; C", "url": "u", "posted_at": "1706858586"}},
     lambda s: feeds.parse_feed(landed(s, {"positions": [{"id": 3, "name": "N", "department": "", "business_unit": "B", "location": "x", "locations": ["A", "C"], "canonicalPositionUrl": "u", "t_create": 1706858586}]}), "netflix"))
feed("google", {"google_11": {"title": "R&D Lead", "location": "Oslo, Norway"}, "google_22": {"title": "Engineer"}, "google_33": {"title": "Nurse", "location": "Bonn, Germany"}},
     lambda s: boards.parse_google(landed(s, '<div>Google | <span a><span b>Oslo, Norway</span></span></div><a class="x" href="jobs/results/11-r-lead?page=1" aria-label="Learn more about R&amp;D Lead">m</a><div>many</div>'
        '<a aria-label="Learn more about Engineer" href="jobs/results/22-engineer">m</a>Google | <span><span>Bonn, Germany</span></span><a href="jobs/results/33-nurse" aria-label="Learn more about Nurse">m</a><a href="jobs/results/11-r-lead" aria-label="Learn more about Again">m</a>')))
case("feed_successfactors", ["url"], [("https://a/job/1",), ("https://a/job/2",)], lambda s: pages.sitemap_postings(s.createDataFrame([
    ("a", "https://a/sitemap.xml", "<sitemapindex><sitemap><loc>https://a/m1.xml</loc></sitemap></sitemapindex>"), ("a", "https://a/m1.xml", "<urlset><loc> https://a/job/1 </loc><loc>https://a/about</loc></urlset>"),
    ("a", "https://a/m2.xml", "<urlset><loc>https://a/job/9</loc></urlset>"), ("b", "https://b/sitemap.xml", "<urlset><loc>https://a/job/2</loc></urlset>")], "slug string, url string, payload string"), "/job/"))
case("feed_marketplace", ["external_id", "title", "location", "company_id"], [("workable_p", "T", "X", 4), ("workable_q", "U", None, None)], lambda s: boards.parse_marketplace(
    landed(s, {"jobs": [{"id": "p", "title": "T", "locations": ["X", "Y"], "company": {"title": " ACME "}}, {"id": "q", "title": "U", "company": {"title": "New Firm", "url": "n"}}, {"id": "r", "title": "no company"}]}),
    s.createDataFrame([(4, "Acme"), (9, "acme")], "id bigint, company_name string"))[0])
case("new_companies", ["company_name", "career_url"], [("new firm", "m")], lambda s: boards.parse_marketplace(
    landed(s, {"jobs": [{"id": "p", "title": "T", "company": {"title": "Acme"}}, {"id": "q", "title": "U", "company": {"title": "New Firm", "url": "n"}}, {"id": "s", "title": "V", "company": {"title": "new firm", "url": "m"}}]}),
    s.createDataFrame([(4, "Acme")], "id bigint, company_name string"))[1])
case("demand_sources", ["source", "external_id", "ats_hint", "company", "apply_url", "title", "location", "posted_at", "workplace_type"], [
    ("roles", "1", "lever", "A", "u1", "Cook", "Oslo", "2024-02-02T07:23:06.000Z", "remote"), ("board", "2", "Ashby", "B", "u2", "Nurse", "Rome", "2024", "onsite"), ("hose", "3", "wd", "C", "u3", "Dev", "Bonn, DE", "2023", "remote"),
], lambda s: boards.demand_records(s.createDataFrame([(k, json.dumps(v)) for k, v in (
    ("roles", {"results": {"jobs": [{"id": 1, "platform": "lever", "company": "A", "companyUrl": "u1", "role": "Cook", "location": "Oslo", "jobCreatedAt": 1706858586, "workplaceType": "Remote"}, {"id": 5, "company": "", "companyUrl": "u"}]}}),
    ("board", {"jobs": [{"provider_job_id": "2", "ats_platform": {"display_name": "Ashby", "name": "x"}, "company": "B", "apply_url": "u2", "title": "Nurse", "location": "Rome", "posted_at": "2024", "workplace_type": "ON_SITE"}]}),
    ("hose", {"jobs": [{"externalId": "3", "source": "wd", "organization": "C", "url": "u3", "title": "Dev", "jobLocations": [{"city": "Bonn", "country": "DE"}], "datePosted": "2023", "isRemote": True}, {"id": "4", "organization": "D", "url": "u4", "title": ""}]}))], "source string, payload string")))
_ADS = [("a", "https://boards.greenhouse.io/acme/jobs/1", "2024-05-01"), ("a", "https://boards.greenhouse.io/acme/jobs/1", "2024-05-01"), ("b", "https://x.example/j", "2024-05-01"), ("c", "https://jobs.lever.co/beta/2", "2023-01-01"), (None, "https://jobs.lever.co/beta/2", "2024-06-01")]
case("aggregator_kept", ["id", "ats", "slug", "careers_url"], [("a", "greenhouse", "acme", "https://boards.greenhouse.io/acme")], lambda s: boards.aggregator_rows(s.createDataFrame(_ADS, "id string, url string, posted_at string"), "2024-01-01")[0])
case("aggregator_dropped", ["reason", "n"], [("kept", 1), ("unknown board", 1), ("too old", 1), ("no id", 1)], lambda s: boards.aggregator_rows(s.createDataFrame(_ADS, "id string, url string, posted_at string"), "2024-01-01")[1])
case("site_table", ["tenant", "pod", "site", "known"], [("a", "wd1", "Ext", True), ("a", "wd1", "Int", True), ("b", None, "b", False)], lambda s: boards.workday_sites(
    s.createDataFrame([("a",), ("b",)], "tenant string"), s.createDataFrame([("a", "wd1", ["Ext", "Int"]), ("z", "wd2", ["S"])], "tenant string, pod string, sites array<string>")))
case("board_map", ["ats", "slug", "url"], [("icims", "careers-acme", "https://careers-acme.icims.com"), ("workday", "t", "https://t.myworkdayjobs.com"), ("zoho", "z", "https://z.zohorecruit.com"), ("lever", "s", "u"), ("successfactors", "jobs.a.com", "https://jobs.a.com/x")],
     lambda s: boards.board_entries(files.read_board_map(s.createDataFrame([(json.dumps({"icims": [{"slug": "x", "url": "https://careers-acme.icims.com/jobs"}], "workday": [{"slug": "t/Site", "url": "q"}, {"slug": "t/Other", "url": "q"}], "zoho": [{"slug": "z", "url": "q"}],
        "lever": [{"slug": "s", "url": "u"}], "nope": [{"slug": "n", "url": "n"}], "successfactors": [{"slug": "y", "url": "https://jobs.a.com/x"}]}),)], "payload string"))))
case("seed_rows", ["career_url", "company_name", "ats", "ats_slug"], [("u2", "B", "lever", "b")], lambda s: boards.seed_rows(
    s.createDataFrame([(1, "u1", "A", "lever", "a"), (2, "u2", "B", "lever", "b"), (3, "u2", "Late", "ashby", "l"), (4, None, "N", "x", "y")], "at int, career_url string, company_name string, ats string, ats_slug string"), s.createDataFrame([("u1",)], "career_url string")))
case("role_titles", ["title"], [("Cook",), ("Nurse",), ("Ward Nurse",)], lambda s: boards.role_titles(
    s.createDataFrame([("Food", ["Cook", "cook "]), ("Health Care", ["Ward Nurse", "Nurse"]), ("Military Services", ["Major"]), ("Empty", [""])], "industry string, titles array<string>"), ["military"]))
case("id_walk", ["id", "state"], [(1, "found"), (2, "missing"), (3, "again"), (4, "again"), (5, "found")], lambda s: boards.id_walk_state(
    s.range(1, 6).toDF("id"), s.createDataFrame([(1, 200), (2, 404), (2, None), (3, 503), (5, None), (5, 200)], "id bigint, status int")))
case("resolved", ["name", "ats", "slug", "state"], [("A", "lever", "a", "placed"), ("B", None, None, "failed"), ("C", None, None, "to resolve"), ("D", None, None, "unknown board"), ("E", "ashby", "s", "shared"), ("F", "ashby", "s", "shared")],
     lambda s: boards.resolved_addresses(
        s.createDataFrame([("A", "https://t.gohiring.com/1"), ("B", "https://apply.workable.com/j/2"), ("C", "https://x.t.gohiring.com/3"), ("D", "https://t.gohiring.com/4"), ("E", "https://t.gohiring.com/5"), ("F", "https://t.gohiring.com/6"), ("G", "https://jobs.lever.co/g")], "name string, url string"),
        s.createDataFrame([("https://t.gohiring.com/1", "https://jobs.lever.co/a/9"), ("https://apply.workable.com/j/2", "FAIL"), ("https://t.gohiring.com/4", "https://d.example/"), ("https://t.gohiring.com/5", "https://jobs.ashbyhq.com/s"), ("https://t.gohiring.com/6", "https://jobs.ashbyhq.com/s/1")], "url string, final_url string")))
case("keyword_discovery", ["slug", "title"], [("new", "First")], lambda s: boards.new_slugs(s.createDataFrame([(1, "New", "First"), (2, "new", "Second"), (3, "have", "H"), (4, "", "E")], "at int, slug string, title string"), s.createDataFrame([("HAVE",)], "ats_slug string")))
case("shards_complete", ["shard", "rows", "complete"], [("s", 13, True), ("t", 10, False)], lambda s: feeds.shard_complete(s.createDataFrame([("s", 0, 10), ("s", 10, 3), ("t", 0, 10)], "shard string, at int, n int"), "shard", "at", "n", 10))
case("shards_to_extend", ["shard", "next_offset"], [("t", 10), ("u", 20)], lambda s: boards.shards_to_extend(
    s.createDataFrame([("s", 0, 10), ("s", 10, 3), ("t", 0, 10), ("u", 0, 10), ("u", 10, None)], "shard string, offset int, count int"), 10))
case("first_site_wins", ["external_id", "title"], [("a", "early"), ("b", "x")], lambda s: feeds.first_site_wins(s.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "x")], "external_id string, site int, title string"), "external_id", "site"))
case("insert_new", ["ats", "slug"], [("a", "y")], lambda s: files.insert_new(s.createDataFrame([("a", "x")], "ats string, slug string"), s.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), (None, "z")], "ats string, slug string"), ["ats", "slug"]))
case("health_line", ["line"], [("jobs=12 dead=0",)], lambda s: files.health_line(s.createDataFrame([(12, None)], "jobs int, dead int")))

# functions

_LD = '<script type="application/ld+json">{"@type":"JobPosting","description":"d","baseSalary":%s}</script>'
function("board_of", "a string", [(" GRNHSE",), ("lever",), ("nope",), (None,)], ["greenhouse", "lever", None, None], lambda a: feeds.board_of(a))
function("board_of_url", "u string", [
    ("https://acme.wd5.myworkdayjobs.com/en-US/Site/job/1",), ("https://boards.greenhouse.io/acme/jobs/1",), ("https://x.tbe.taleo.net/p/ats",), ("https://recruiting.paylocity.com/Recruiting/Jobs/All/0A1B2C3D-0000-1111-2222-333344445555/x",),
    ("https://recruiting.paylocity.com/Recruiting/Jobs/Details/12",), ("https://wd1.myworkdaysite.com/recruiting/ten/Site",), ("https://jobs.lever.co/careers",), ("https://own.example/careers",), (None,)],
    ['{"ats":"workday","slug":"acme","careers_url":"https://acme.myworkdayjobs.com"}', '{"ats":"greenhouse","slug":"acme","careers_url":"https://boards.greenhouse.io/acme"}', None,
     '{"ats":"paylocity","slug":"0a1b2c3d-0000-1111-2222-333344445555","careers_url":"https://recruiting.paylocity.com/recruiting/jobs/All/0a1b2c3d-0000-1111-2222-333344445555"}', None,
     '{"ats":"workday","slug":"ten","careers_url":"https://wd1.myworkdaysite.com/recruiting/ten"}', None, None, None], text.board_of_url)
function("board_in_html", "h string", [('<script src="https://boards.greenhouse.io/embed/job_board/js?for=Acme">',), ('<a href="https://www.recruitee.com">x</a> https://beta.recruitee.com',), ('https://jobs.lever.co/gamma"',), ("https://careerfoo.successfactors.eu/x",), ("nothing",)],
         ['{"ats":"greenhouse","slug":"Acme"}', None, '{"ats":"lever","slug":"gamma"}', '{"ats":"successfactors","slug":"foo"}', None], text.board_in_html)
function("native_id", "u string, e string, a string", [
    ("https://x/y?gh_jid=55", "greenhouse_1", "greenhouse"), ("https://x/jobs/66?a", "greenhouse_1", "greenhouse"), ("https://jobs.lever.co/a/0a1b2c3d-0000-1111-2222-333344445555", "lever_z", "lever"), ("https://j/co/1234567-cook", "smartrecruiters_9", "smartrecruiters"),
    ("https://j/co/x", "smartrecruiters_9", "smartrecruiters"), ("https://a/titel-77?x", "personio_2", "personio"), (None, "comeet_A", "comeet")], ["55", "66", "0a1b2c3d-0000-1111-2222-333344445555", "1234567", "9", "77", "A"], text.native_id)
function("html_to_text", "h string", [("<p>One&nbsp;two</p><br/><li>A &amp; B</li>  c",), ("<div></div>",), ("it&#39;s &lt;ok&gt;",)], ["One two\n\nA & B\n c", None, "it's <ok>"], text.html_to_text)
function("longest_span", "h string", [('<i class="text">' + "a" * 201 + '</span><i class="text">' + "b" * 300 + "</span>",), ('<i class="text">short</span>',)], ["b" * 300, None], text.longest_span)
function("json_ld_pay", "h string", [(_LD % '{"currency":"USD","value":{"minValue":10,"maxValue":20,"unitText":"HOUR"}}',), (_LD % '{"currency":"EUR","value":{"value":"300","unitText":"day"}}',), (_LD % '{"currency":"EUR","value":{"minValue":"","maxValue":""}}',), ("no script",)],
         ['{"low":"10","high":"20","currency":"USD","interval":"hour"}', '{"low":"300","high":"300","currency":"EUR","interval":"day"}', None, None], feeds.json_ld_pay)
function("description_of", "h string", [('<script type="application/ld+json">{"@type":"Thing"}</script><script type="application/ld+json">{"@type":"JobPosting","description":"d"}</script>',), ('<div id="job-description"> body </div>',), (f'<meta property="og:description" content="{"o" * 101}">',), ('<meta name="description" content="short">',)],
         ["d", "body", "o" * 101, None], feeds.description_of)
function("free_text_pay", "t string", [("$90k–$120k / year",), ("€17,50 per hour",), ("competitive",)], ['{"low":90000.0,"high":120000.0,"currency":"USD","interval":"year"}', '{"low":1750.0,"currency":"EUR","interval":"hour"}', None], feeds.free_text_pay)
function("dollar_range", "t string", [("pay $60,000 - $90,000.50 a year",), ("$9,000 - $20,000",)], ['{"low":60000,"high":90000}', None], pages.dollar_range)
function("answer_verdict", "s int, u string, f string, h string", [
    (404, "https://b/job/abc12345", None, ""), (503, "u", None, ""), (200, "https://b/job/abc12345", "https://b/", "y" * 600), (200, "https://b/job/abc12345", "https://b/x/ABC12345", "y" * 600), (200, "u", None, "This position has been FILLED " + "y" * 600),
    (200, "u", None, "Sorry, try later"), (200, "u", None, "short but fine"), (None, "u", None, None)], ["false", None, "false", "true", "false", "false", "true", None], liveness.answer_verdict)
function("rendered_verdict", "t string", [("tiny",), ("Captcha. This job has expired. " + "z" * 300,), ("This vacancy is closed. " + "z" * 300,), ("We hire. " + "z" * 300,), (None,)], [None, None, "false", "true", None], liveness.rendered_verdict)
function("two_phase", "a boolean, r boolean", [(False, True), (True, False), (True, None), (None, True), (None, None)], ["false", "false", None, "true", None], liveness.two_phase_verdict)
function("redirected_off", "u string, f string", [("https://b/job/abc12345", "https://b/"), ("https://b/job/abc12345", "https://b/new/abc12345"), ("https://b/job/x1", "https://b/"), ("https://b/job/abc12345", None)], ["true", "false", "false", "false"], text.redirected_off)
function("public_https", "u string", [("https://a.example/x",), ("http://a.example",), ("https://10.0.0.1/",), ("https://db.internal/",), ("https://localhost/",), (None,)], ["true", "false", "false", "false", "false", "false"], names.public_https)
function("image_type", "b binary", [(b"\x89PNG....",), (b"\xff\xd8\xff",), (b"GIF89a",), (b"RIFF1234WEBP",), (b"\x00\x00\x01\x00",), (b" <svg x",), (b"<html>",)], ["image/png", "image/jpeg", "image/gif", "image/webp", "image/x-icon", "image/svg+xml", None], names.image_type)
function("usable_image", "b binary", [(b"x" * 199,), (b"x" * 200,), (b"y" * 200,)], ["false", "true", "false"], lambda b: names.usable_image(b, ["3a5ad11d37b3d6e4dc3c7fbd4fbb3ee1", __import__("hashlib").md5(b"y" * 200).hexdigest()]))
function("best_icon", "i array<struct<url: string, apple: boolean, px: int>>", [([("a.ico", True, 512), ("b.png", False, 32), ("c.png", True, 16)],), ([("d.png", False, 64), ("e.png", False, 64)],), ([],)], ["c.png", "d.png", None], names.best_icon)
function("truncated_bytes", "t string", [("é" * 1301,), ("ok",)], ["é" * 1300, "ok"], lambda t: names.truncated_bytes(t, 2601))
function("rotated", "a array<int>, n int", [([1, 2, 3], 1), ([1, 2, 3], 5), ([], 2)], ["[2,3,1]", "[3,1,2]", "[]"], names.rotated)
function("best_name", "n array<struct<name: string, jobs: int>>", [([("Acme", 9), ("Acme Inc", 1), ("ACME INC", 3)],)], ["ACME INC"], names.best_name)
function("one_employer", "n array<string>", [(["IBM", "International Business Machines"],), (["Acme", "Acme Inc."],), (["Acme", "Beta"],)], ["true", "true", "false"], names.one_employer)
function("most_specific", "p array<string>", [(["India", "Pune, Maharashtra, India"],), (["A, B", "C, D"],)], ["Pune, Maharashtra, India", "A, B"], pages.most_specific)
function("between_anchors", "a array<struct<at: int, value: string>>, m array<struct<at: int, value: string>>", [([(10, "x"), (20, "y"), (40, "z")], [(5, "p"), (30, "q")])], ['[{"value":"x","mark":"p"},{"value":"y"},{"value":"z","mark":"q"}]'], pages.between_anchors)
function("hidden_json", "h string", [('<input id="jobs" value="[&quot;a&quot;]">',), ('<input value="[1]" name="jobs">',), ("<p>",)], ['["a"]', "[1]", None], lambda h: pages.hidden_json(h, "jobs"))
function("labelled_pairs", "h string", [("<dt>Type</dt><dd>Full</dd><dt> TYPE</dt> <dd><b>Part</b></dd><dt>Empty</dt><dd> </dd>",)], ['{"type":"Part"}'], pages.labelled_pairs)
function("microdata", "h string", [('<meta itemprop="title" content=" Nurse ">',), ("<meta content='Cook' itemprop='title'>",), ("<p>",)], ["Nurse", "Cook", None], lambda h: pages.microdata(h, "title"))
function("unescaped", "t string", [("caf&eacute; &#8364; &#x41;",), (None,)], ["café € A", None], pages.unescaped)
function("balanced_div", "h string, c string", [('<div class="x body"><div>a</div>b</div>c', "body"), ("<p>", "body")], ["<div>a</div>b", None], pages.balanced_div)
function("repaired_json", "t string", [(r"{\x22a\x22:\-1}",)], ['{"a":-1}'], pages.repaired_json)
function("model_answer", "t string", [('```json\n{"is_remote": true, "remote_worldwide": false, "visa_sponsorship": "unknown", "experience_level": "senior"}\n```',), ('{"is_remote": "maybe"}',), ("text",)],
         ['{"is_remote":true,"remote_worldwide":false,"experience_level":"senior"}', None, None], pages.model_answer)
function("structured_workplace", "t string, l string, f string", [("Nurse", "Oslo", "not remote"), ("Hybrid cook", None, "remote"), ("Dev", "Anywhere", None), ("Dev", "Oslo", "On-site"), ("Dev", "Oslo", None)], ["onsite", "hybrid", "remote", "onsite", None], pages.structured_workplace)
function("vendor_posting", "u string", [("https://acme.wd5.myworkdayjobs.com/en-US/Site/job/Oslo/Nurse_R1",), ("https://acme.fa.em2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/123",), ("https://x.example/job/1",)],
         ['{"vendor":"workday","host":"acme.wd5.myworkdayjobs.com","tenant":"acme","site":"Site","id":"/job/Oslo/Nurse_R1"}', '{"vendor":"oracle","host":"acme.fa.em2.oraclecloud.com","tenant":"acme","site":"CX_1","id":"123"}', None], pages.vendor_posting)
function("demand_key", "q string, l string, e string, x string, m string, r boolean", [
    (" Data  Engineer ", None, "Full-time", "", None, True), ("a" * 300, "Oslo", None, None, "hybrid", True), (None, " ", "", None, None, False)], ["data engineer||full-time||remote", "a" * 200 + "|oslo|||hybrid", None], text.demand_key)
function("employment_type", "t string", [("Internship - Full Time",), ("Permanent - Part Time",), ("temps plein",), ("full_time",), ("PRN",), ("B2B",), ("other",), ("R&amp;D contract",)], ["Internship", "Part-time", "Full-time", "Full-time", "Temporary", "Contract", None, "Contract"], classify.employment_type)
function("workplace_type", "t string", [("hybrid remote",), ("on_site",), ("unspecified",), ("Remote-first",)], ["Hybrid", "Onsite", None, "Remote"], classify.workplace_type)
function("experience_level", "t string, d string", [("Account Executive", None), ("HR Business Partner", None), ("Executive Assistant", None), ("Sales Intern", None), ("Senior Manager", None), ("Associate Director", None), ("Software Engineer II", None)],
         ["mid", "mid", "entry", "internship", "senior", "entry", "mid"], classify.experience_level)
function("location_tokens", "l string", [("London, England, GB, GB",), ("San Francisco, CA, US",), (None,)], ['["london","england","gb"]', '["san francisco","san","francisco","ca","us"]', "[]"], places.location_tokens)
function("epoch", "n string", [("1706858586",), ("1706858586472",), ("soon",)], ["2024-02-02T07:23:06.000Z", "2024-02-02T07:23:06.472Z", None], windows.epoch_or_null)
_PLACES = [
    "London, England, GB, GB", "Navi Mumbai, Maharashtra, IN, IN", "Wilmington, DE", "Berlin, DE", "Toronto, ON, CA", "Indianapolis, IN, US", "Remote - U.S.", "New Mexico, US", "Jersey City, NJ", "Hong Kong", "Sarajevo, Bosnia and Herzegovina", "Yangon, Myanmar",
    "Kinshasa, DR Congo", "Abidjan, Cote d'Ivoire", "Castries, Saint Lucia", "Port of Spain, Trinidad and Tobago", "Papua New Guinea", "Bissau, Guinea-Bissau", "Kingstown, Saint Vincent and the Grenadines", "Macao", "Ankara, Turkey", "Prague, Czech Republic", "Gaza, Palestine",
]
case("case_countries", ["n", "country"], [
    (0, "gb"), (1, "in"), (4, "ca"), (5, "us"), (6, "us"), (7, "mx"), (7, "us"), (8, "je"), (9, "hk"), (10, "ba"), (11, "mm"), (12, "cd"), (12, "cg"), (13, "ci"), (14, "lc"), (15, "tt"), (15, "es"), (16, "pg"), (16, "gn"), (17, "gn"), (19, "mo"), (20, "tr"), (21, "cz"), (22, "ps"),
], lambda s: places.with_countries(s.createDataFrame(list(enumerate(_PLACES)), "n int, location string"), "location", "n"))
_TERMS = ["germany", "ca", "Deutschland", "espana", "phillipines", "british colombia", "dach", "berlin"]
_SPOTS = ["Berlin, Germany", "Madrid, Spain", "Manila, Philippines", "Vancouver, British Columbia, CA", "Wien, Austria", "Berlin, DE"]
case("place_terms", ["term", "n"], [("germany", 0), ("ca", 3), ("Deutschland", 0), ("espana", 1), ("phillipines", 2), ("british colombia", 3), ("dach", 0), ("dach", 4), ("berlin", 0), ("berlin", 5)],
     lambda s: (lambda d: __import__("functools").reduce(DataFrame.unionByName, [places.place_filter(d, t).withColumn("term", F.lit(t)) for t in _TERMS]))(s.createDataFrame(list(enumerate(_SPOTS)), "n int, location string")))
case("retired", ["id", "gone", "checked"], [(1, True, True), (2, False, True), (3, False, False), (4, True, True)], lambda s: liveness.retire(
    s.createDataFrame([(1, None, None), (2, None, None), (3, None, None), (4, "2020-01-01 00:00:00", None)], "id int, removed_at string, last_checked_at string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("removed_at", "last_checked_at")}),
    s.createDataFrame([(1, False), (2, None), (2, True), (4, True)], "id int, alive boolean"), F.expr("TIMESTAMP_NTZ '2025-06-01 00:00:00'")).select("id", F.col("removed_at").isNotNull().alias("gone"), F.col("last_checked_at").isNotNull().alias("checked")))
