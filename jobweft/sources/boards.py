"""Postings of boards whose pages need more than one shape: listings with details, packed fields, hidden JSON, aggregators.

Everything reads landed payloads. A listing frame has (slug, payload), a detail frame (slug, id, payload).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweft.functions.text import board_of_url, host_of, path_of
from jobweft.schemas import SNAPSHOT_FIELDS
from jobweft.sources.feeds import board_of, free_text_pay, json_ld_posting
from jobweft.sources.pages import dollar_range, flex_pay, hidden_json, labelled_pairs, most_specific, packed_fields, value_like


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _rows(d: DataFrame, values: dict[str, Column], *more: str) -> DataFrame:
    return d.select("slug", *more, *[values.get(n, F.lit(None)).cast("string").alias(n) for n in SNAPSHOT_FIELDS])


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def _whole(c: Column) -> Column:
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def add_details(listing: DataFrame, details: DataFrame, prefix: str) -> DataFrame:
    """Listing rows, each with the payload of its detail as _detail, null where none landed."""
    d = details.groupBy(F.col("slug").alias("_slug"), F.concat(F.lit(prefix), "id").alias("_id")).agg(F.min("payload").alias("_detail"))
    return listing.join(d, (F.col("slug") == F.col("_slug")) & (F.col("external_id") == F.col("_id")), "left").drop("_slug", "_id")


def smartrecruiters_details(listing: DataFrame, details: DataFrame) -> DataFrame:
    """The sections of a detail, in their order, are the description; a yearly range of dollars in it is the pay."""
    shape = "postingUrl string, jobAd struct<sections: map<string, struct<text: string>>>"
    d = add_details(listing, details, "smartrecruiters_").withColumn("_d", F.from_json("_detail", shape))
    texts = F.filter(F.transform(F.map_values("_d.jobAd.sections"), lambda s: s["text"]), lambda t: t != "")
    d = d.withColumn("description", F.nullif(F.array_join(texts, "\n"), F.lit(""))).withColumn("_pay", dollar_range(F.col("description")))
    return d.withColumns({
        "salary_min": F.col("_pay.low").cast("bigint").cast("string"), "salary_max": F.col("_pay.high").cast("bigint").cast("string"), "salary_currency": F.when(F.col("_pay").isNotNull(), "USD"),
        "url": F.coalesce(_some(F.col("_d.postingUrl")), "url")}).drop("_d", "_detail", "_pay")


def rippling_details(listing: DataFrame, details: DataFrame) -> DataFrame:
    """Company, role and compensation of a detail, one under the other."""
    d = add_details(listing, details, "rippling_").withColumn("_d", F.from_json("_detail", "description struct<company: string, role: string, compensation: string>"))
    parts = F.array_compact(F.array(*[_some(F.col(f"_d.description.{n}")) for n in ("company", "role", "compensation")]))
    return d.withColumn("description", F.nullif(F.array_join(parts, "\n"), F.lit(""))).drop("_d", "_detail")


def bamboohr_details(listing: DataFrame, details: DataFrame) -> DataFrame:
    """A detail's pay note, description, address and date go before the listing's."""
    shape = "compensation string, description string, location struct<city: string, state: string, addressCountry: string>, jobOpeningShareUrl string, datePosted string"
    d = add_details(listing, details, "bamboohr_").withColumn("_d", F.from_json("_detail", shape)).withColumn("_pay", free_text_pay(F.col("_d.compensation")))
    place = F.nullif(F.concat_ws(", ", *[_some(F.col(f"_d.location.{n}")) for n in ("city", "state", "addressCountry")]), F.lit(""))
    return d.withColumns({
        "location": F.coalesce(place, "location"), "description": F.coalesce(_some(F.col("_d.description")), "description"), "url": F.coalesce(_some(F.col("_d.jobOpeningShareUrl")), "url"),
        "posted_at": F.coalesce("_d.datePosted", "posted_at"), "salary_min": _whole(F.col("_pay.low")), "salary_max": _whole(F.col("_pay.high")), "salary_currency": F.col("_pay.currency"),
        "salary_interval": F.col("_pay.interval")}).drop("_d", "_detail", "_pay")


def oracle_details(listing: DataFrame, details: DataFrame) -> DataFrame:
    """Description parts, department and labelled pay fields of a detail; the first label of a kind that is filled counts."""
    shape = ("items array<struct<ExternalDescriptionStr: string, ExternalQualificationsStr: string, ExternalResponsibilitiesStr: string, Department: string, Organization: string, BusinessUnit: string, "
             "requisitionFlexFields: array<struct<Prompt: string, Value: string>>>>")
    d = add_details(listing, details, "oracle_").withColumn("_d", F.get(F.from_json("_detail", shape)["items"], F.lit(0)))
    parts = F.array_compact(F.array(*[_some(F.col(f"_d.{n}")) for n in ("ExternalDescriptionStr", "ExternalQualificationsStr", "ExternalResponsibilitiesStr")]))
    labelled = F.filter("_d.requisitionFlexFields", lambda f: (f["Prompt"] != "") & (f["Value"] != ""))
    pairs = F.transform(labelled, lambda f: F.struct(F.lower(F.trim(f["Prompt"])).alias("key"), f["Value"].alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    d = d.withColumn("_pay", flex_pay(F.map_from_entries(last)))
    return d.withColumns({
        "description": F.coalesce(F.nullif(F.array_join(parts, "\n"), F.lit("")), "description"), "department": F.coalesce(*[_some(F.col(f"_d.{n}")) for n in ("Department", "Organization", "BusinessUnit")], F.col("department")),
        "salary_min": _whole(F.col("_pay.low")), "salary_max": _whole(F.col("_pay.high")), "salary_currency": F.col("_pay.currency")}).drop("_d", "_detail", "_pay")


def workday_departments(postings: DataFrame, facets: DataFrame) -> DataFrame:
    """Postings with the department under whose facet (slug, department, external_id) they were listed; of several the first by name."""
    first = facets.groupBy(F.col("slug").alias("_slug"), F.col("external_id").alias("_id")).agg(F.min("department").alias("_department"))
    d = postings.join(first, (F.col("slug") == F.col("_slug")) & (F.col("external_id") == F.col("_id")), "left")
    return d.withColumn("department", F.coalesce("department", "_department")).drop("_slug", "_id", "_department")


def workday_sites(tenants: DataFrame, table: DataFrame) -> DataFrame:
    """(tenant, pod, site, known): each site of a tenant by the table (tenant, pod, sites); one that is not in it is kept with its own name to be tried."""
    d = tenants.join(table, "tenant", "left")
    return d.select("tenant", "pod", F.explode(F.coalesce("sites", F.array("tenant"))).alias("site"), F.col("sites").isNotNull().alias("known"))


def parse_zoho(df: DataFrame) -> DataFrame:
    """Postings of the hidden JSON of a page, with ``preview``: whether the description is cut short, so that the detail is wanted."""
    shape = ("array<struct<id: string, Posting_Title: string, Job_Opening_Name: string, City: string, State: string, Country: string, Country1: string, Remote_Job: boolean, Job_Type: string, "
             "Department: string, Industry: string, Job_Description: string, Date_Opened: string, Publish: boolean>>")
    listed = F.get_json_object(hidden_json(F.col("payload"), "meta"), "$.list_url")
    d = df.select("slug", listed.alias("_list"), F.explode(F.from_json(hidden_json(F.col("payload"), "jobs"), shape)).alias("j")).where("coalesce(j.Publish, true)")
    title = F.coalesce(_some(F.col("j.Posting_Title")), _some(F.col("j.Job_Opening_Name")))
    dashed = F.regexp_replace(F.coalesce("j.Posting_Title", F.lit("")), "[^a-zA-Z0-9]+", "-")
    text = F.col("j.Job_Description")
    d = d.withColumn("preview", text.isNull() | (F.length(text) < 600) | F.trim(F.regexp_replace(text, "<[^>]+>", "")).rlike(r"(?:\.\.\.|…)$"))
    return _rows(d, {
        "external_id": F.concat(F.lit("zoho_"), "j.id"), "title": title, "department": F.coalesce(_some(F.col("j.Department")), _some(F.col("j.Industry"))),
        "location": F.nullif(F.concat_ws(", ", _some(F.col("j.City")), _some(F.col("j.State")), F.coalesce(_some(F.col("j.Country")), _some(F.col("j.Country1")))), F.lit("")),
        "workplace_type": F.when(F.col("j.Remote_Job"), "remote"), "employment_type": _some(F.col("j.Job_Type")), "description": _some(text), "posted_at": F.col("j.Date_Opened"),
        "url": F.coalesce(F.concat("_list", F.lit("/"), "j.id", F.lit("/"), dashed), F.concat(F.lit("https://"), "slug", F.lit(".zohorecruit.com/jobs/Careers/"), "j.id"))}, "preview").where("external_id IS NOT NULL")


def parse_jazzhr(df: DataFrame) -> DataFrame:
    """Postings of a widget's blocks; of a page without blocks those of its links, titled by their addresses. The first of equal ids counts."""
    link = r'href="(https://[^"]*\.applytojob\.com/apply/([^/"]+)/([^"?]+)[^"]*)"'
    block = r'(?is)class="resumator-job-title[^"]*"[^>]*>([^<]+)</div>\s*<div[^>]*class="resumator-job-info[^"]*"[^>]*>([\s\S]*?)</div>\s*<div[^>]*>[\s\S]*?href="(https://[^"]*\.applytojob\.com/apply/([^/"]+)/[^"]*)"'
    p = F.col("payload")
    groups = lambda pattern, **names: F.arrays_zip(*[F.regexp_extract_all(p, F.lit(pattern), i).alias(n) for n, i in names.items()])
    d = df.select("slug", groups(block, title=1, info=2, url=3, id=4).alias("_b"), groups(link, url=1, id=2, words=3).alias("_l"))
    part = lambda info, label: F.nullif(F.trim(F.regexp_extract(info, rf"(?i){label}:\s*</span>([^<]*)", 1)), F.lit(""))
    entry = lambda x, title, info: F.struct(x["id"].alias("id"), F.trim(title).alias("title"), part(info, "Location").alias("location"), part(info, "Department").alias("department"), x["url"].alias("url"))
    blocks = F.transform("_b", lambda x: entry(x, x["title"], x["info"]))
    links = F.transform("_l", lambda x: entry(x, F.regexp_replace(F.try_url_decode(x["words"]), "-", " "), F.lit("")))
    d = d.select("slug", F.posexplode(F.when(F.size("_b") > 0, blocks).otherwise(links)).alias("at", "j"))
    d = d.groupBy("slug", F.col("j.id").alias("_i")).agg(F.min_by("j", "at").alias("j"))
    return _rows(d, {"external_id": F.concat(F.lit("jazzhr_"), "_i"), **{n: F.col(f"j.{n}") for n in ("title", "location", "department", "url")}})


def parse_icims(df: DataFrame) -> DataFrame:
    """Postings of a portal page: links whose title reads "ID - Title"; the first of equal ids counts."""
    anchor = r'(?is)<a[^>]*href="([^"]+)"[^>]*title="([^"\s]+) - ([^"]+)"[^>]*class="iCIMS_Anchor"'
    found = F.arrays_zip(*[F.regexp_extract_all("payload", F.lit(anchor), i).alias(n) for i, n in ((1, "url"), (2, "id"), (3, "title"))])
    d = df.select("slug", F.posexplode(found).alias("at", "j")).groupBy("slug", F.col("j.id").alias("_i")).agg(F.min_by("j", "at").alias("j"))
    return _rows(d, {"external_id": F.concat(F.lit("icims_"), "_i"), "title": F.trim("j.title"), "url": F.col("j.url")})


def icims_details(listing: DataFrame, details: DataFrame) -> DataFrame:
    """What a detail page labels goes before the listing; JSON-LD stands in where nothing is labelled. Any label that holds location, but no type, is the place."""
    d = add_details(listing, details, "icims_")
    html = F.col("_detail")
    d = d.withColumns({"_m": labelled_pairs(html), "_ld": json_ld_posting(html), "_t": F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<div[^>]*class="[^"]*iCIMS_Expandable_Text[^"]*"[^>]*>([\s\S]*?)</div>'), 1), _plain)})
    ld = lambda path: F.nullif(F.get_json_object("_ld", path), F.lit(""))
    place = F.get(F.map_values(F.map_filter("_m", lambda k, _: k.contains("location") & ~k.contains("type"))), F.lit(0))
    place = F.coalesce(place, F.col("_m")["city"], F.nullif(F.concat_ws(", ", *[ld(f"$.jobLocation.address.{n}") for n in ("addressLocality", "addressRegion", "addressCountry")]), F.lit("")))
    kind = F.coalesce(*[F.col("_m")[k] for k in ("type", "job type", "schedule", "employment type")], ld("$.employmentType"))
    group = F.coalesce(*[F.col("_m")[k] for k in ("category", "department", "job category")], value_like(F.col("_m"), "category"), value_like(F.col("_m"), "department"))
    text = F.coalesce(F.nullif(F.array_join(F.filter("_t", lambda t: F.length(t) > 10), "\n\n"), F.lit("")), _plain(ld("$.description")))
    head = _some(F.regexp_extract(html, r'(?is)<h1[^>]*class="[^"]*iCIMS_Header[^"]*"[^>]*>([^<]+)', 1))
    new = {"title": head, "location": place, "employment_type": kind, "department": group, "description": text}
    return d.withColumns({k: F.coalesce(v, F.col(k)) for k, v in new.items()}).drop("_m", "_ld", "_t", "_detail")


def parse_taleo(df: DataFrame) -> DataFrame:
    """Postings of packed pages (slug, id, payload). The field before the id is the title; of the twenty behind it what looks like a place, a schedule and a name of a department."""
    f = packed_fields(F.col("payload"))
    d = df.select("slug", "id", f.alias("f")).withColumn("at", F.array_position("f", F.col("id")).cast("int")).where("at >= 2")
    rest = F.transform(F.slice("f", F.col("at") + 1, 20), lambda x: F.trim(x))
    first = lambda pattern, skip=None: F.get(F.filter(F.col("r"), lambda x: x.rlike(pattern) & (~x.rlike(skip) if skip else F.lit(True))), F.lit(0))
    d = d.withColumn("r", rest).withColumn("place", first("^[A-Z]{2}-"))
    other = F.get("r", F.array_position("r", F.col("place")).cast("int") + 1)
    # What a schedule begins with, and what names no department.
    schedule = "(?i)^(?:Full-time|Part-time|Contractor|Temporary|Intern|Casual)"
    department = r"(?i)^\d|^[A-Z]{2}-|^(?:Full|Part|Contract|Temp|Intern|Casual|Ongoing|true|false)|^\w{3} \d{1,2}, \d{4}|^\d{1,2}-\w{3}-\d{4}"
    return _rows(d, {
        "external_id": F.concat(F.lit("taleo_"), "id"), "title": _some(F.get("f", F.col("at") - 2)), "employment_type": first(schedule), "department": first("^.{6,}$", department),
        "location": F.when(other.rlike("^[A-Z]{2}-|,"), F.concat_ws("; ", "place", other)).otherwise(F.col("place")),
        "url": F.concat(F.lit("https://"), "slug", F.lit(".taleo.net/careersection/jobdetail.ftl?job="), "id")})


def parse_google(df: DataFrame) -> DataFrame:
    """Postings of a results page. A place belongs to a link only if it stands between the link before and this one."""
    anchor = r'(?i)<a\b[^>]*?(?:href="jobs/results/(\d+)-[a-z0-9-]+(?:[?#][^"]*)?"[^>]*?aria-label="Learn more about ([^"]+)"|aria-label="Learn more about ([^"]+)"[^>]*?href="jobs/results/(\d+)-[a-z0-9-]+(?:[?#][^"]*)?")[^>]*>'
    # the page is cut behind each link: what a piece holds before its link lies between the two
    d = df.select("slug", F.posexplode(F.split("payload", r'(?i)(?<=<a\b[^>]{0,900}aria-label="Learn more about [^"]{1,300}"[^>]{0,900}>)')).alias("at", "piece"))
    got = lambda i: F.nullif(F.regexp_extract("piece", anchor, i), F.lit(""))
    d = d.select("slug", "at", F.coalesce(got(1), got(4)).alias("id"), F.coalesce(got(2), got(3)).alias("title"), _some(F.regexp_extract("piece", r"(?i)Google\s*\|\s*<span[^>]*>\s*<span[^>]*>([^<]+)<", 1)).alias("place"))
    d = d.where("id IS NOT NULL").groupBy("slug", "id").agg(F.min_by(F.struct("title", "place"), "at").alias("j"))
    return _rows(d, {"external_id": F.concat(F.lit("google_"), "id"), "title": F.regexp_replace("j.title", "&amp;", "&"), "location": F.col("j.place")})


def jobvite_details(listing: DataFrame, details: DataFrame) -> DataFrame:
    """JSON-LD of a detail: the most specific of its places, pay whose empty fields are no amounts, and the workplace the wording of title and place tells."""
    d = add_details(listing, details, "jobvite_").withColumn("_ld", json_ld_posting(F.col("_detail")))
    place = "struct<address: struct<addressLocality: string, addressRegion: string, addressCountry: string>>"
    one, many = F.from_json(F.get_json_object("_ld", "$.jobLocation"), place), F.from_json(F.get_json_object("_ld", "$.jobLocation"), f"array<{place}>")
    places = F.coalesce(many, F.array(one))
    names = F.filter(F.transform(places, lambda p: F.concat_ws(", ", *[_some(p["address"][n]) for n in ("addressLocality", "addressRegion", "addressCountry")])), lambda t: t != "")
    amount = lambda n: F.when((v := F.regexp_replace(F.get_json_object("_ld", f"$.baseSalary.value.{n}"), r"[,\s]", "").try_cast("double")) > 0, _whole(v))
    text = F.lower(F.concat_ws(" ", "title", "location"))
    d = d.withColumn("location", F.coalesce(most_specific(names), "location"))
    return d.withColumns({
        "description": F.coalesce(_some(F.get_json_object("_ld", "$.description")), "description"), "salary_min": amount("minValue"), "salary_max": amount("maxValue"),
        "salary_currency": _some(F.get_json_object("_ld", "$.baseSalary.currency")), "salary_interval": F.lower(_some(F.get_json_object("_ld", "$.baseSalary.value.unitText"))),
        "workplace_type": F.when(text.rlike(r"\bhybrid\b"), "hybrid").when(text.rlike(r"\bremote\b|\bwork from home\b|\bwfh\b"), "remote")}).drop("_ld", "_detail")


def parse_marketplace(pages: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of a marketplace's landed pages, with the stored company they belong to, and the companies that are new: one per name, with the least address."""
    shape = "jobs array<struct<id: string, title: string, locations: array<string>, workplace: string, employmentType: string, url: string, created: string, company: struct<id: string, title: string, url: string>>>"
    j = pages.select(F.explode(F.from_json("payload", shape)["jobs"]).alias("j")).where("j.id IS NOT NULL AND j.company.title IS NOT NULL").dropDuplicates(["j"])
    j = j.select(F.concat(F.lit("workable_"), "j.id").alias("external_id"), "j.title", F.get("j.locations", F.lit(0)).alias("location"), F.col("j.workplace").alias("workplace_type"), F.col("j.employmentType").alias("employment_type"),
                 "j.url", F.col("j.created").alias("posted_at"), F.lower(F.trim("j.company.title")).alias("_name"), F.col("j.company.url").alias("_site"))
    have = companies.groupBy(F.lower(F.trim("company_name")).alias("_name")).agg(F.min("id").alias("company_id"))
    both = j.join(have, "_name", "left")
    new = both.where("company_id IS NULL").groupBy(F.col("_name").alias("company_name")).agg(F.min("_site").alias("career_url"))
    return both.drop("_name", "_site"), new


def demand_records(payloads: DataFrame) -> DataFrame:
    """Postings of three kinds of demand sources (source, payload) in one shape; records without an id, company or address are left out."""
    mode = lambda c: F.when(F.upper(c) == "REMOTE", "remote").when(F.upper(c) == "HYBRID", "hybrid").when(F.upper(c).isin("ONSITE", "ON_SITE"), "onsite")
    of = lambda source, shape, root: payloads.where(F.col("source") == source).select("source", F.explode(F.from_json("payload", shape)[root] if "." not in root else F.from_json("payload", shape)[root.split(".")[0]][root.split(".")[1]]).alias("j"))
    out = lambda d, **c: d.select("source", *[c.get(n, F.lit(None)).cast("string").alias(n) for n in ("external_id", "ats_hint", "company", "apply_url", "title", "location", "description", "posted_at", "workplace_type")])
    j = lambda n: F.col(f"j.{n}")
    a = of("roles", "results struct<jobs: array<struct<id: string, platform: string, company: string, companyUrl: string, role: string, location: string, description: string, formattedDescription: string, jobCreatedAt: bigint, workplaceType: string>>>", "results.jobs")
    b = of("board", "jobs array<struct<provider_job_id: string, ats_platform: string, company: string, apply_url: string, title: string, location: string, description: string, posted_at: string, workplace_type: string>>", "jobs")
    c = of("hose", "jobs array<struct<externalId: string, id: string, source: string, organization: string, url: string, title: string, jobLocations: array<struct<city: string, country: string>>, locationType: string, "
           "descriptionText: string, descriptionHtml: string, datePosted: string, isRemote: boolean, aiWorkArrangement: string>>", "jobs")
    first = F.get(j("jobLocations"), F.lit(0))
    hint = F.coalesce(F.get_json_object(j("ats_platform"), "$.display_name"), F.get_json_object(j("ats_platform"), "$.name"), F.when(~j("ats_platform").startswith("{"), j("ats_platform")))
    rows = [
        out(a, external_id=j("id"), ats_hint=j("platform"), company=j("company"), apply_url=j("companyUrl"), title=j("role"), location=j("location"), description=F.coalesce(_some(j("description")), _some(j("formattedDescription"))),
            posted_at=F.date_format(F.timestamp_seconds(j("jobCreatedAt")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), workplace_type=mode(j("workplaceType"))),
        out(b, external_id=j("provider_job_id"), ats_hint=hint, company=j("company"), apply_url=j("apply_url"), title=j("title"), location=j("location"), description=_some(j("description")), posted_at=j("posted_at"), workplace_type=mode(j("workplace_type"))),
        out(c.where("j.title <> ''"), external_id=F.coalesce(j("externalId"), j("id")), ats_hint=j("source"), company=j("organization"), apply_url=j("url"), title=j("title"),
            location=F.when(first.isNotNull(), F.nullif(F.concat_ws(", ", _some(first["city"]), _some(first["country"])), F.lit(""))).otherwise(j("locationType")), description=F.coalesce(_some(j("descriptionText")), _some(j("descriptionHtml"))),
            posted_at=j("datePosted"), workplace_type=mode(F.coalesce(_some(j("aiWorkArrangement")), F.when(j("isRemote"), "Remote").otherwise(j("locationType"))))),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).where("external_id <> '' AND company <> '' AND apply_url <> ''")


def aggregator_rows(postings: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Postings (id, url, posted_at) of an aggregator with the board, slug and careers page their address names; and counts of why others were dropped.

    A posting counts once; older ones than ``cutoff`` and those of unknown boards are dropped.
    """
    d = postings.dropDuplicates(["id"]).withColumn("_b", board_of_url(F.col("url")))
    d = d.withColumn("reason", F.when(F.col("id").isNull(), "no id").when(F.col("posted_at") < F.lit(cutoff), "too old").when(F.col("_b").isNull(), "unknown board").otherwise("kept"))
    return d.where("reason = 'kept'").select("id", "url", "posted_at", "_b.*"), d.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def board_entries(maps: DataFrame) -> DataFrame:
    """(ats, name, slug, url) of read_board_map with the slugs and addresses that the boards go by; boards that are not supported are left out."""
    host = F.regexp_replace(host_of(F.col("url")), r"^www\.", "")
    slug = F.when(F.col("ats") == "icims", F.regexp_replace(host, r"\.icims\.com$", "")).when(F.col("ats") == "workday", F.split("slug", "/")[0]).when(F.col("ats") == "successfactors", host).otherwise(F.col("slug"))
    d = maps.withColumn("ats", board_of(F.col("ats"))).where("ats IS NOT NULL").withColumn("slug", slug).where("slug <> ''")
    url = (F.when(F.col("ats") == "icims", F.concat(F.lit("https://"), "slug", F.lit(".icims.com"))).when(F.col("ats") == "workday", F.concat(F.lit("https://"), "slug", F.lit(".myworkdayjobs.com")))
           .when(F.col("ats") == "zoho", F.concat(F.lit("https://"), "slug", F.lit(".zohorecruit.com"))).otherwise(F.col("url")))
    return d.withColumn("url", url).dropDuplicates(["ats", "slug"])


def seed_rows(seeds: DataFrame, have: DataFrame) -> DataFrame:
    """Rows of a seed list that are not stored yet, by their address; the first of equal ones counts (column at)."""
    first = seeds.where("career_url IS NOT NULL").groupBy("career_url").agg(F.min_by(F.struct("company_name", "ats", "ats_slug"), "at").alias("s"))
    return first.select("career_url", "s.*").join(have.select("career_url").distinct(), "career_url", "left_anti")


def role_titles(vocabulary: DataFrame, skip: list[str]) -> DataFrame:
    """(title) of a vocabulary (industry, titles): distinct whatever their case, the first spelling by name, industries that hold a word of ``skip`` left out."""
    d = vocabulary
    for word in skip:
        d = d.where(~F.contains(F.lower("industry"), F.lit(word.lower())))
    return d.select(F.explode("titles").alias("title")).groupBy(F.lower(F.trim("title")).alias("_t")).agg(F.min(F.trim("title")).alias("title")).where("_t <> ''").select("title")


def id_walk_state(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, state) of an id range: found, missing (404, never asked again) or again (dropped, or not answered yet); the best answer of an id counts."""
    rank = F.when(F.col("status") == 200, 0).when(F.col("status").isin(404, 410), 1).otherwise(2)
    best = answers.groupBy("id").agg(F.min(rank).alias("r"))
    return asked.join(best, "id", "left").select("id", F.when(F.col("r") == 0, "found").when(F.col("r") == 1, "missing").otherwise("again").alias("state"))


def resolved_addresses(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows (name, url) whose address only leads on to another, with the board behind it by the landed resolutions (url, final_url).

    A resolution that failed reads FAIL. ``state``: placed, failed, unknown board, or to resolve. A board
    and slug that several names claim belongs to none of them (state shared).
    """
    host = host_of(F.col("url"))
    wrapped = host.rlike(r"(?:^|\.)t\.gohiring\.com$") | (host.rlike(r"(?:^|\.)apply\.workable\.com$") & path_of(F.col("url")).rlike("^/j(?:/|$)"))
    d = rows.where(wrapped).join(resolved.groupBy("url").agg(F.max("final_url").alias("final_url")), "url", "left").withColumn("_b", board_of_url(F.col("final_url")))
    d = d.select("name", "url", "_b.ats", "_b.slug", F.when(F.col("final_url").isNull(), "to resolve").when(F.col("final_url") == "FAIL", "failed").when(F.col("_b").isNull(), "unknown board").otherwise("placed").alias("state"))
    claims = d.where("state = 'placed'").groupBy("ats", "slug").agg((F.min("name") != F.max("name")).alias("shared"))
    d = d.join(claims, ["ats", "slug"], "left")
    return d.select("name", "url", "ats", "slug", F.when(F.coalesce("shared", F.lit(False)), "shared").otherwise(F.col("state")).alias("state"))


def shards_to_extend(pages: DataFrame, size: int) -> DataFrame:
    """(shard, next_offset) of shards whose last planned page was a full one; pages (shard, offset, count, planned), resumed ones count as full (count null)."""
    d = pages.groupBy("shard").agg(F.max("offset").alias("last"), F.max_by(F.coalesce("count", F.lit(size)), "offset").alias("n"))
    return d.where(F.col("n") >= size).select("shard", (F.col("last") + size).alias("next_offset"))


def new_slugs(hits: DataFrame, have: DataFrame) -> DataFrame:
    """(slug, title) of organisations that a keyword search found and that are not stored: the first title of a slug (column at) counts."""
    first = hits.where("slug <> ''").groupBy(F.lower("slug").alias("slug")).agg(F.min_by("title", "at").alias("title"))
    return first.join(have.select(F.lower("ats_slug").alias("slug")).distinct(), "slug", "left_anti")


