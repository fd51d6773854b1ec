import json

from pyspark.sql import functions as F

from jobweft.sources import feeds, files
from jobweft.streaming import pipelines  # noqa: F401


def parsed(spark, feed, payload, slug="acme"):
    df = spark.createDataFrame([(slug, payload if isinstance(payload, str) else json.dumps(payload)), ("bad", "<html>"), ("null", None)], "slug string, payload string")
    return [r.asDict() for r in feeds.parse_feed(df, feed).collect()]


def test_every_feed_reads_nothing_from_rubbish(spark):
    for feed in feeds.FEEDS:
        assert parsed(spark, feed, "[]") == []


def test_json_feeds(spark):
    [r] = parsed(spark, "greenhouse", {"jobs": [{"id": 7, "title": "T", "departments": [{"name": "D"}], "location": None, "absolute_url": "u", "updated_at": "2024"}]})
    assert (r["external_id"], r["department"], r["location"], r["posted_at"]) == ("greenhouse_7", "D", "Remote", "2024")
    [r] = parsed(spark, "lever", [{"id": "x", "text": "T", "categories": {"team": "A", "location": "B"}, "createdAt": 1706858586472, "descriptionPlain": "d", "lists": [{"text": "L", "content": "c"}, {"text": "", "content": "c"}], "additional": "e"}])
    assert r["description"] == "d\n\nL:\nc\n\ne" and r["posted_at"] == "2024-02-02T07:23:06.472Z"
    [r] = parsed(spark, "workable", {"results": [{"shortcode": "S", "title": "T", "location": {"city": "C", "region": None, "country": "K"}, "remote": True, "type": "full"}]})
    assert (r["location"], r["workplace_type"], r["employment_type"], r["url"]) == ("C, K", "Remote", "Full-time", "https://apply.workable.com/acme/j/S/")
    [r] = parsed(spark, "recruitee", {"offers": [{"id": 1, "title": "T", "hybrid": True, "salary": {"min": 1, "max": 2, "currency": "EUR", "period": "year"}}]})
    assert (r["workplace_type"], r["salary_min"], r["salary_interval"], r["url"]) == ("hybrid", "1", "year", "https://acme.recruitee.com/o/1")
    [a, b] = sorted(parsed(spark, "rippling", {"0": {"uuid": "a", "name": "A", "workLocation": {"label": "Remote (US)"}}, "1": {"uuid": "b", "name": "B"}}), key=lambda x: x["title"])
    assert (a["workplace_type"], b["location"], b["url"]) == ("remote", "Remote", "https://ats.rippling.com/acme/jobs/b")
    [r] = parsed(spark, "pinpoint", {"data": [{"id": 1, "title": "T", "workplace_type": "on_site", "description": "d", "benefits": "b", "benefits_header": "Perks"}]})
    assert (r["workplace_type"], r["description"]) == ("onsite", "d\n<h3>Perks</h3>b")
    [r] = parsed(spark, "comeet", [{"uid": "1", "name": "", "employment_type": "Freelance", "workplace_type": "Elsewhere"}], slug="U:T:x")
    assert (r["title"], r["employment_type"], r["workplace_type"], r["url"]) == ("Untitled", "Contract", "Elsewhere", "https://www.comeet.co/jobs/U/1")
    [r] = parsed(spark, "bamboohr", {"result": [{"id": "4", "jobOpeningName": "T", "locationType": "2", "employmentStatusLabel": "Active"}]})
    assert (r["workplace_type"], r["employment_type"]) == ("hybrid", None)
    [r] = parsed(spark, "paylocity", '<script>window.pageData = {"Jobs": [{"JobId": 3, "JobTitle": "T", "JobLocation": {"City": "C"}}]};</script>')
    assert (r["external_id"], r["location"]) == ("paylocity_3", "C")
    [r] = parsed(spark, "ashby", {"jobs": [{"id": "1", "title": "T", "isRemote": True, "compensation": {"summaryComponents": [{"minValue": 5, "currencyCode": "USD"}]}}]})
    assert (r["workplace_type"], r["salary_min"], r["salary_currency"]) == ("Remote", "5", "USD")
    [r] = parsed(spark, "smartrecruiters", {"content": [{"id": "1", "name": "T", "location": {"city": "X", "remote": True}}]})
    assert (r["location"], r["workplace_type"]) == ("X", "remote")


def test_more_json_feeds(spark):
    [r] = parsed(spark, "breezy", [{"friendly_id": "f", "name": "T", "location": {"name": "", "city": "C", "is_remote": True}, "salary": "$90k - $120,000 / year"}])
    assert (r["external_id"], r["location"], r["workplace_type"], r["salary_min"], r["salary_max"], r["salary_interval"]) == ("breezy_f", "C", "remote", "90000", "120000", "year")
    [r] = parsed(spark, "workday", {"jobPostings": [{"title": "T", "externalPath": "/job/X", "locationsText": "L", "bulletFields": ["R-1"]}]}, slug="acme.wd5/Site")
    assert (r["external_id"], r["url"]) == ("workday_R-1", "https://acme.wd5.myworkdayjobs.com/Site/job/X")
    rows = parsed(spark, "oracle", {"items": [{"requisitionList": [{"Id": 1, "Title": "T", "PrimaryLocation": "A", "secondaryLocations": [{"Name": "B"}, {"Name": "A"}]}]}, {"requisitionList": [{"Id": 2, "Title": "U"}]}]})
    assert sorted((r["external_id"], r["location"]) for r in rows) == [("oracle_1", "A; B"), ("oracle_2", None)]
    [r] = parsed(spark, "amazon", {"jobs": [{"id_icims": "9", "title": " T ", "business_category": "b", "location": "L", "job_path": "/en/jobs/9"}]})
    assert (r["title"], r["department"], r["url"]) == ("T", "b", "https://www.amazon.jobs/en/jobs/9")
    [r] = parsed(spark, "netflix", {"positions": [{"id": 3, "name": "N", "locations": ["A", "B"], "t_create": 1706858586}]})
    assert (r["location"], r["posted_at"]) == ("A; B", "1706858586")


def test_xml_feeds(spark):
    rss = "<rss><item><guid>g</guid><title><![CDATA[A & B]]></title><link>l</link><remoteStatus>fully</remoteStatus><tt:city>C</tt:city><tt:country>K</tt:country></item><item><title>no guid</title></item></rss>"
    [r] = feeds.parse_rss(spark.createDataFrame([("s", rss)], "slug string, payload string")).collect()
    assert (r["title"], r["workplace_type"], r["location"], r["capped"]) == ("A & B", "remote", "C, K", False)
    xml = "<position><id>5</id><name>N</name><jobDescription><name>H</name><value><![CDATA[<p>x</p>]]></value></jobDescription></position>"
    [r] = feeds.parse_positions_xml(spark.createDataFrame([("s", xml)], "slug string, payload string")).collect()
    assert (r["external_id"], r["description"], r["location"]) == ("personio_5", "<h3>H</h3><p>x</p>", "Remote")


def test_listing_takes_the_nearest_heading_before(spark):
    html = "<a href='/j/0'>Z</a><i>Oslo</i><h3>Ops</h3><a href='/j/1'>A</a><i>US, US</i><h3>Dev <b>x</b></h3><a href='/j/2'>B</a><i><div class='jv-meta'>2 Locations</div></i>"
    rows = feeds.parse_headed_listing(spark.createDataFrame([("s", html)], "slug string, payload string"), link=r"(?is)<a href='/j/(\d+)'>(.*?)</a><i>(.*?)</i>").collect()
    assert sorted((r["id"], r["title"], r["location"], r["department"]) for r in rows) == [("0", "Z", "Oslo", None), ("1", "A", "US", "Ops"), ("2", "B", None, "Dev x")]


def test_pages(spark):
    html = '<script type="application/ld+json">{"@type":"Thing"}</script><script type="application/ld+json">{"@type":"JobPosting","description":"d"}</script>'
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(feeds.description_of(F.col("h")).alias("x")).first()["x"] == "d"
    pay = lambda t: spark.createDataFrame([(t,)], "t string").select(feeds.free_text_pay(F.col("t")).alias("x")).first()["x"]
    assert tuple(pay("$90k–$120k / year")) == (90000.0, 120000.0, "USD", "year") and pay("competitive") is None
    board = spark.createDataFrame([(" GRNHSE",), ("lever",), ("nope",)], "a string").select(feeds.board_of(F.col("a")).alias("b")).collect()
    assert [r["b"] for r in board] == ["greenhouse", "lever", None]


def test_sites_and_shards(spark):
    pages = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "x")], "external_id string, site int, title string")
    assert sorted((r["external_id"], r["title"]) for r in feeds.first_site_wins(pages, "external_id", "site").collect()) == [("a", "early"), ("b", "x")]
    shards = spark.createDataFrame([("s", 0, 10), ("s", 10, 3), ("t", 0, 10)], "shard string, at int, n int")
    assert sorted(tuple(r) for r in feeds.shard_complete(shards, "shard", "at", "n", 10).collect()) == [("s", 13, True), ("t", 10, False)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,slug,url\n"A ""x"", b",s,u\nshort,s2\n')
    schema = "name string, slug string, url string"
    assert files.read_csv(spark, str(tmp_path / "a.csv"), schema).count() == 2
    assert [r["name"] for r in files.read_csv(spark, str(tmp_path / "a.csv"), schema, short_rows="drop").collect()] == ['A "x", b']
    (tmp_path / "b.jsonl").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    assert files.read_json_lines(spark, str(tmp_path / "b.jsonl"), "id int").where("id IS NOT NULL").count() == 2
    maps = spark.createDataFrame([('{"lever": [{"name": "N", "slug": "s", "url": "u"}]}',)], "payload string")
    assert [tuple(r) for r in files.read_board_map(maps).collect()] == [("lever", "N", "s", "u")]
    files.write_csv(maps, str(tmp_path / "out"))
    files.write_json_lines(maps, str(tmp_path / "out2"))
    have = spark.createDataFrame([("a", "x")], "ats string, slug string")
    new = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), (None, "z")], "ats string, slug string")
    assert [tuple(r) for r in files.insert_new(have, new, ["ats", "slug"]).collect()] == [("a", "y")]
    assert [r["k"] for r in files.walk_ids(spark, 0, 10, 4, 1, spark.createDataFrame([(5,)], "k bigint"), "k").collect()] == [1, 9]
    assert files.health_line(spark.createDataFrame([(1, None)], "a int, b int")).first()["line"] == "a=1 b=0"
