"""Landed payloads of job boards turned into snapshot rows.

A feed is data: the shape of one posting, where the postings lie in the payload, and an SQL expression
for each field. Catalyst reads only the parts of the JSON that the fields wanted need. Nothing here
fetches: ``df`` has the columns slug and payload, one row per landed response.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweft.schemas import BOARD_ALIASES, SNAPSHOT_FIELDS, SUPPORTED_BOARDS


@dataclass(frozen=True)
class Feed:
    """``shape`` is the DDL of one posting; ``root`` the field of their array, empty if the payload is the array; ``inner`` that of arrays within it.

    ``values`` reads an object's values. ``pay`` is an expression of a free-text pay note that gives the salary fields.
    """

    shape: str
    root: str = ""
    inner: str = ""
    pay: str = ""
    values: bool = False
    fields: dict[str, str] = field(default_factory=dict)
    where: str = "external_id IS NOT NULL"


def _place(*parts: str) -> str:
    return f"nullif(concat_ws(', ', {', '.join(f'nullif({p}, {chr(39)}{chr(39)})' for p in parts)}), '')"


def _mode(text: str, otherwise: str = "null") -> str:
    t = f"lower({text})"
    return f"CASE WHEN {t} LIKE '%remote%' THEN 'remote' WHEN {t} LIKE '%hybrid%' THEN 'hybrid' WHEN {t} LIKE '%site%' OR {t} LIKE '%office%' THEN 'onsite' ELSE {otherwise} END"


_SECTION = "CASE WHEN j.{0} <> '' THEN concat('<h3>', coalesce(nullif(j.{0}_header, ''), '{1}'), '</h3>', j.{0}) END"
# The public shapes of the feeds and the field each value stands for.
FEEDS = {
    "greenhouse": Feed(
        "id string, title string, departments array<struct<name:string>>, location struct<name:string>, content string, absolute_url string, first_published string, updated_at string", "jobs",
        fields={"external_id": "'greenhouse_' || j.id", "title": "j.title", "department": "try_element_at(j.departments, 1).name", "location": "coalesce(nullif(j.location.name, ''), 'Remote')",
                "description": "j.content", "url": "j.absolute_url", "posted_at": "coalesce(j.first_published, j.updated_at)"}),
    "ashby": Feed(
        "id string, title string, department string, location string, isRemote boolean, workplaceType string, employmentType string, descriptionHtml string, descriptionPlain string, jobUrl string, publishedAt string, "
        "compensation struct<summaryComponents:array<struct<minValue:string,maxValue:string,currencyCode:string,interval:string>>>", "jobs",
        fields={"external_id": "'ashby_' || j.id", "title": "j.title", "department": "j.department", "location": "j.location", "workplace_type": "coalesce(j.workplaceType, if(j.isRemote, 'Remote', null))",
                "employment_type": "j.employmentType", "salary_min": "try_element_at(j.compensation.summaryComponents, 1).minValue", "salary_max": "try_element_at(j.compensation.summaryComponents, 1).maxValue",
                "salary_currency": "try_element_at(j.compensation.summaryComponents, 1).currencyCode", "salary_interval": "try_element_at(j.compensation.summaryComponents, 1).interval",
                "description": "coalesce(nullif(j.descriptionHtml, ''), j.descriptionPlain)", "url": "j.jobUrl", "posted_at": "j.publishedAt"}),
    "lever": Feed(
        "id string, text string, categories struct<team:string,department:string,location:string,commitment:string>, workplaceType string, salaryRange struct<min:string,max:string,currency:string,interval:string>, "
        "description string, descriptionPlain string, lists array<struct<text:string,content:string>>, additional string, additionalPlain string, hostedUrl string, createdAt bigint",
        fields={"external_id": "'lever_' || j.id", "title": "j.text", "department": "coalesce(j.categories.team, j.categories.department)", "location": "coalesce(nullif(j.categories.location, ''), 'Remote')",
                "workplace_type": "j.workplaceType", "employment_type": "j.categories.commitment", "salary_min": "j.salaryRange.min", "salary_max": "j.salaryRange.max", "salary_currency": "j.salaryRange.currency",
                "salary_interval": "j.salaryRange.interval", "url": "j.hostedUrl", "posted_at": "date_format(timestamp_millis(j.createdAt), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
                "description": "nullif(concat_ws('\\n\\n', coalesce(nullif(j.descriptionPlain, ''), nullif(j.description, '')), array_join(transform(filter(j.lists, x -> x.text <> '' AND x.content <> ''), "
                               "x -> concat(x.text, ':\\n', x.content)), '\\n\\n'), coalesce(nullif(j.additionalPlain, ''), nullif(j.additional, ''))), '')"}),
    "workable": Feed(
        "shortcode string, title string, department array<string>, location struct<city:string,region:string,country:string>, remote boolean, workplace string, type string, published string", "results",
        fields={"external_id": "'workable_' || j.shortcode", "title": "j.title", "department": "try_element_at(j.department, 1)", "location": f"coalesce({_place('j.location.city', 'j.location.region', 'j.location.country')}, 'Remote')",
                "workplace_type": "if(coalesce(j.remote, false), 'Remote', j.workplace)", "employment_type": "CASE j.type WHEN 'full' THEN 'Full-time' WHEN 'part' THEN 'Part-time' ELSE j.type END",
                "url": "concat('https://apply.workable.com/', slug, '/j/', j.shortcode, '/')", "posted_at": "j.published"}),
    "recruitee": Feed(
        "id string, title string, department string, location string, city string, country string, remote boolean, hybrid boolean, on_site boolean, employment_type_code string, "
        "salary struct<min:string,max:string,currency:string,period:string>, description string, careers_url string, slug string, published_at string", "offers",
        fields={"external_id": "'recruitee_' || j.id", "title": "j.title", "department": "j.department", "location": f"coalesce(nullif(j.location, ''), {_place('j.city', 'j.country')})",
                "workplace_type": "CASE WHEN j.remote THEN 'remote' WHEN j.hybrid THEN 'hybrid' WHEN j.on_site THEN 'onsite' END", "employment_type": "j.employment_type_code", "salary_min": "j.salary.min",
                "salary_max": "j.salary.max", "salary_currency": "j.salary.currency", "salary_interval": "j.salary.period", "description": "j.description",
                "url": "coalesce(j.careers_url, concat('https://', slug, '.recruitee.com/o/', coalesce(j.slug, j.id)))", "posted_at": "j.published_at"}),
    "smartrecruiters": Feed(
        "id string, name string, department struct<label:string>, location struct<fullLocation:string,city:string,remote:boolean,hybrid:boolean>, typeOfEmployment struct<label:string>, releasedDate string", "content",
        fields={"external_id": "'smartrecruiters_' || j.id", "title": "j.name", "department": "j.department.label", "location": "coalesce(nullif(j.location.fullLocation, ''), nullif(j.location.city, ''), 'Remote')",
                "workplace_type": "CASE WHEN j.location.remote THEN 'remote' WHEN j.location.hybrid THEN 'hybrid' END", "employment_type": "j.typeOfEmployment.label",
                "url": "concat('https://jobs.smartrecruiters.com/', slug, '/', j.id)", "posted_at": "j.releasedDate"}),
    "rippling": Feed(
        "uuid string, name string, department struct<label:string>, workLocation struct<label:string>, url string", values=True,
        fields={"external_id": "'rippling_' || j.uuid", "title": "j.name", "department": "j.department.label", "location": "coalesce(nullif(j.workLocation.label, ''), 'Remote')",
                "workplace_type": "if(lower(j.workLocation.label) LIKE 'remote%', 'remote', null)", "url": "coalesce(j.url, concat('https://ats.rippling.com/', slug, '/jobs/', j.uuid))"}),
    "pinpoint": Feed(
        "id string, title string, department struct<name:string>, location struct<name:string>, workplace_type string, remote boolean, employment_type_text string, employment_type string, compensation_minimum string, "
        "compensation_maximum string, compensation_currency string, compensation_frequency string, description string, key_responsibilities string, key_responsibilities_header string, skills_knowledge_expertise string, "
        "skills_knowledge_expertise_header string, benefits string, benefits_header string, url string, published_at string, created_at string", "data",
        fields={"external_id": "'pinpoint_' || j.id", "title": "j.title", "department": "j.department.name", "location": "j.location.name", "workplace_type": _mode("j.workplace_type", "if(j.remote, 'remote', null)"),
                "employment_type": "coalesce(j.employment_type_text, j.employment_type)", "salary_min": "j.compensation_minimum", "salary_max": "j.compensation_maximum", "salary_currency": "j.compensation_currency",
                "salary_interval": "j.compensation_frequency", "url": "coalesce(j.url, concat('https://', slug, '.pinpointhq.com/postings/', j.id))", "posted_at": "coalesce(j.published_at, j.created_at)",
                "description": "nullif(concat_ws('\\n', nullif(j.description, ''), " + ", ".join(
                    _SECTION.format(c, h) for c, h in (("key_responsibilities", "Key Responsibilities"), ("skills_knowledge_expertise", "Skills, Knowledge and Expertise"), ("benefits", "Benefits"))) + "), '')"}),
    "comeet": Feed(
        "uid string, name string, department string, location struct<city:string,state:string,country:string>, workplace_type string, employment_type string, details struct<description:string>, url_active_page string, time_updated string",
        fields={"external_id": "'comeet_' || j.uid", "title": "coalesce(nullif(j.name, ''), 'Untitled')", "department": "j.department", "location": _place("j.location.city", "j.location.state", "j.location.country"),
                "workplace_type": _mode("j.workplace_type", "j.workplace_type"),
                "employment_type": "CASE WHEN lower(j.employment_type) LIKE '%full%' THEN 'Full-time' WHEN lower(j.employment_type) LIKE '%part%' THEN 'Part-time' WHEN lower(j.employment_type) LIKE '%contract%' "
                                   "OR lower(j.employment_type) LIKE '%freelance%' THEN 'Contract' WHEN lower(j.employment_type) LIKE '%intern%' THEN 'Internship' ELSE j.employment_type END",
                "description": "j.details.description", "url": "coalesce(j.url_active_page, concat('https://www.comeet.co/jobs/', split_part(slug, ':', 1), '/', j.uid))", "posted_at": "j.time_updated"}),
    "bamboohr": Feed(
        "id string, jobOpeningName string, departmentLabel string, location struct<city:string,state:string,addressCountry:string>, locationType string, isRemote boolean, employmentStatusLabel string", "result",
        fields={"external_id": "'bamboohr_' || j.id", "title": "j.jobOpeningName", "department": "j.departmentLabel", "location": _place("j.location.city", "j.location.state", "j.location.addressCountry"),
                "workplace_type": "CASE WHEN j.isRemote OR j.locationType = '3' OR lower(j.departmentLabel) LIKE '%remote%' THEN 'remote' WHEN j.locationType = '2' THEN 'hybrid' END",
                "employment_type": "CASE WHEN lower(j.employmentStatusLabel) NOT IN ('active', 'inactive', 'open', 'closed', '') THEN j.employmentStatusLabel END",
                "url": "concat('https://', slug, '.bamboohr.com/careers/', j.id)"}),
    "paylocity": Feed(
        "JobId string, JobTitle string, HiringDepartment string, LocationName string, JobLocation struct<City:string,State:string>, IsRemote boolean, PublishedDate string", "Jobs",
        fields={"external_id": "'paylocity_' || j.JobId", "title": "j.JobTitle", "department": "j.HiringDepartment", "location": f"coalesce({_place('j.JobLocation.City', 'j.JobLocation.State')}, j.LocationName)",
                "workplace_type": "if(j.IsRemote, 'remote', null)", "posted_at": "j.PublishedDate"}),
    "breezy": Feed(
        "id string, friendly_id string, name string, department string, location struct<name:string,city:string,is_remote:boolean>, type struct<name:string>, salary string, url string, published_date string", pay="j.salary",
        fields={"external_id": "'breezy_' || coalesce(j.id, j.friendly_id)", "title": "j.name", "department": "j.department", "location": "coalesce(nullif(j.location.name, ''), j.location.city)",
                "workplace_type": "if(j.location.is_remote, 'remote', null)", "employment_type": "j.type.name", "url": "coalesce(j.url, concat('https://', slug, '.breezy.hr/p/', j.friendly_id))", "posted_at": "j.published_date"}),
    "workday": Feed(
        "title string, externalPath string, locationsText string, postedOn string, bulletFields array<string>", "jobPostings",
        fields={"external_id": "'workday_' || coalesce(try_element_at(j.bulletFields, 1), j.externalPath)", "title": "j.title", "location": "j.locationsText",
                "url": "concat('https://', split_part(slug, '/', 1), '.myworkdayjobs.com/', split_part(slug, '/', 2), j.externalPath)"}),
    "oracle": Feed(
        "Id string, Title string, PrimaryLocation string, secondaryLocations array<struct<Name:string>>, WorkplaceType string, JobSchedule string, ShortDescriptionStr string, PostedDate string", "items", "requisitionList",
        fields={"external_id": "'oracle_' || j.Id", "title": "j.Title", "location": "nullif(array_join(array_distinct(array_compact(concat(array(j.PrimaryLocation), coalesce(j.secondaryLocations.Name, array())))), '; '), '')",
                "workplace_type": "j.WorkplaceType", "employment_type": "j.JobSchedule", "description": "j.ShortDescriptionStr", "posted_at": "j.PostedDate"}),
    "amazon": Feed(
        "id_icims string, id string, title string, job_category string, business_category string, normalized_location string, location string, job_schedule_type string, description string, job_path string, posted_date string", "jobs",
        fields={"external_id": "'amazon_' || coalesce(j.id_icims, j.id)", "title": "nullif(trim(j.title), '')", "department": "coalesce(nullif(j.job_category, ''), nullif(j.business_category, ''))",
                "location": "coalesce(nullif(j.normalized_location, ''), j.location)", "employment_type": "j.job_schedule_type", "description": "j.description", "url": "concat('https://www.amazon.jobs', j.job_path)", "posted_at": "j.posted_date"}),
    "netflix": Feed(
        "id string, name string, department string, business_unit string, location string, locations array<string>, job_description string, canonicalPositionUrl string, t_create string, t_update string", "positions",
        fields={"external_id": "'netflix_' || j.id", "title": "nullif(trim(j.name), '')", "department": "coalesce(nullif(j.department, ''), j.business_unit)", "location": "coalesce(nullif(array_join(j.locations, '; '), ''), j.location)",
                "description": "j.job_description", "url": "j.canonicalPositionUrl", "posted_at": "coalesce(j.t_create, j.t_update)"}),
}
#: Where a page holds its postings as an object of JavaScript.
EMBEDDED = {"paylocity": r"window\.pageData\s*=\s*(\{[\s\S]*?\});\s*</script>"}


def board_of(label: Column) -> Column:
    """The supported board that a label names, null for any other."""
    folded = F.lower(F.trim(label))
    aliases = F.create_map(*[F.lit(x) for k, v in BOARD_ALIASES.items() for x in (k, v)])
    board = F.coalesce(aliases[folded], folded)
    return F.when(board.isin(SUPPORTED_BOARDS), board)


def parse_feed(df: DataFrame, feed: str, *, slug: str = "slug", payload: str = "payload") -> DataFrame:
    """Snapshot rows (slug and the snapshot fields) of landed payloads. A payload that isn't the feed's JSON gives no row."""
    f = FEEDS[feed]
    text = F.regexp_extract(F.col(payload), EMBEDDED[feed], 1) if feed in EMBEDDED else F.col(payload)
    if f.inner:
        items = F.flatten(F.from_json(text, f"{f.root} array<struct<{f.inner}: array<struct<{_struct(f.shape)}>>>>")[f.root][f.inner])
    elif f.values:
        items = F.map_values(F.from_json(text, f"map<string, struct<{_struct(f.shape)}>>"))
    elif f.root:
        items = F.from_json(text, f"{f.root} array<struct<{_struct(f.shape)}>>")[f.root]
    else:
        items = F.from_json(text, f"array<struct<{_struct(f.shape)}>>")
    rows = df.select(F.col(slug).alias("slug"), F.explode(items).alias("j"))
    fields = [F.expr(f.fields[n]).cast("string").alias(n) if n in f.fields else F.to_json("j").alias(n) if n == "raw_data" else F.lit(None).cast("string").alias(n) for n in SNAPSHOT_FIELDS]
    out = rows.select("slug", *fields, *([F.expr(f.pay).alias("_pay")] if f.pay else [])).where(f.where)
    if f.pay:
        pay = free_text_pay(F.col("_pay"))
        whole = lambda c: F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
        out = out.withColumns({"salary_min": whole(pay["low"]), "salary_max": whole(pay["high"]), "salary_currency": pay["currency"], "salary_interval": pay["interval"]}).drop("_pay")
    return out


def _struct(ddl: str) -> str:
    """DDL of columns as DDL of struct fields: a colon behind each outer name."""
    out, depth, start = [], 0, True
    for part in ddl.split():
        if start and depth == 0:
            out.append(part + ":")
            start = False
        else:
            out.append(part + " ")
            depth += part.count("<") - part.count(">")
            start = part.endswith(",") and depth == 0
    return "".join(out).strip()


def _tag(name: str, block: Column) -> Column:
    value = F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>([\s\S]*?)</{name}>", 1)
    return F.nullif(F.trim(F.regexp_replace(value, r"<!\[CDATA\[([\s\S]*?)\]\]>", "$1")), F.lit(""))


def parse_rss(df: DataFrame, *, slug: str = "slug", payload: str = "payload", cap: int = 100) -> DataFrame:
    """Snapshot rows and ``capped`` of RSS feeds: one per item that has a guid and a link; a feed of ``cap`` items may be cut off."""
    items = F.regexp_extract_all(F.col(payload), F.lit(r"(?is)<item>([\s\S]*?)</item>"), 1)
    d = df.select(F.col(slug).alias("slug"), (F.size(items) >= cap).alias("capped"), F.explode(items).alias("b"))
    b, status = F.col("b"), F.lower(_tag("remoteStatus", F.col("b")))
    values = {
        "external_id": F.concat(F.lit("teamtailor_"), _tag("guid", b)), "title": _tag("title", b), "department": _tag("tt:department", b),
        "location": F.nullif(F.concat_ws(", ", _tag("tt:city", b), _tag("tt:country", b)), F.lit("")),
        "workplace_type": F.when(status == "fully", "remote").when(status == "hybrid", "hybrid").when(status == "none", "onsite"),
        "description": _tag("description", b), "url": _tag("link", b), "posted_at": _tag("pubDate", b),
    }
    return d.select("slug", "capped", *[values.get(n, F.lit(None).cast("string")).alias(n) for n in SNAPSHOT_FIELDS]).where("external_id IS NOT NULL AND url IS NOT NULL")


def parse_positions_xml(df: DataFrame, *, slug: str = "slug", payload: str = "payload") -> DataFrame:
    """Snapshot rows of XML feeds of <position> blocks, whose named sections become headed parts of the description."""
    d = df.select(F.col(slug).alias("slug"), F.explode(F.regexp_extract_all(F.col(payload), F.lit(r"(?s)<position>([\s\S]*?)</position>"), 1)).alias("b"))
    b = F.col("b")
    one = lambda t: F.nullif(F.trim(F.regexp_extract(b, f"<{t}>([^<]*)</{t}>", 1)), F.lit(""))
    section = r"(?s)<jobDescription>[\s\S]*?<name>([^<]*)</name>[\s\S]*?<value>\s*<!\[CDATA\[([\s\S]*?)\]\]>\s*</value>[\s\S]*?</jobDescription>"
    parts = F.arrays_zip(F.regexp_extract_all(b, F.lit(section), 1).alias("n"), F.regexp_extract_all(b, F.lit(section), 2).alias("v"))
    body = F.array_join(F.transform(F.filter(parts, lambda p: F.trim(p["v"]) != ""), lambda p: F.concat(F.lit("<h3>"), F.trim(p["n"]), F.lit("</h3>"), F.trim(p["v"]))), "\n")
    values = {
        "external_id": F.concat(F.lit("personio_"), one("id")), "title": one("name"), "department": one("department"), "location": F.coalesce(one("office"), F.lit("Remote")),
        "employment_type": F.coalesce(one("schedule"), one("employmentType")), "description": F.nullif(body, F.lit("")), "posted_at": one("createdAt"),
        "url": F.concat(F.lit("https://"), F.col("slug"), F.lit(".jobs.personio.de/job/"), one("id"), F.lit("?language=en")),
    }
    return d.select("slug", *[values.get(n, F.lit(None).cast("string")).alias(n) for n in SNAPSHOT_FIELDS]).where("external_id IS NOT NULL")


def parse_headed_listing(df: DataFrame, *, link: str, heading: str = r"(?is)<h3[^>]*>([\s\S]*?)</h3>", slug: str = "slug", payload: str = "payload") -> DataFrame:
    """Rows (slug, id, title, location, department) of HTML listings; a posting's department is the nearest heading before it.

    ``link`` has three groups: id, title and location. Positions are found within the page, one page at
    a time, as a search in the arrays of its own headings and links.
    """
    text = F.col("p")
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))
    d = df.select(F.col(slug).alias("slug"), F.col(payload).alias("p"))
    # the page is cut before each heading: the first heading of a piece is the nearest before its links
    pieces = F.split(text, f"(?={heading})")
    d = d.select("slug", F.explode(pieces).alias("piece"))
    d = d.select("slug", F.nullif(strip(F.regexp_extract("piece", heading, 1)), F.lit("")).alias("department"), F.explode(F.arrays_zip(*[
        F.regexp_extract_all("piece", F.lit(link), i).alias(n) for i, n in ((1, "id"), (2, "title"), (3, "location"))])).alias("m"))
    parts = F.filter(F.transform(F.split(strip(F.col("m.location")), ","), lambda x: F.trim(x)), lambda x: x != "")
    once = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, 1, i), lambda y: F.lower(y) == F.lower(x)))
    place = F.when(~F.col("m.location").contains("jv-meta"), F.nullif(F.array_join(once, ", "), F.lit("")))
    return d.select("slug", F.col("m.id").alias("id"), strip(F.col("m.title")).alias("title"), place.alias("location"), "department")


def json_ld_posting(html: Column) -> Column:
    """The first JSON-LD block of a page that is a JobPosting, as text; null if there is none."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>([\s\S]*?)</script>"), 1)
    return F.get(F.filter(blocks, lambda b: F.coalesce(F.get_json_object(b, "$['@type']"), F.get_json_object(b, "$[0]['@type']"), F.lit("")).contains("JobPosting")), F.lit(0))


def description_of(html: Column) -> Column:
    """A page's description: its JSON-LD, else the body of a named container, else its og:description or meta description beyond 100 characters."""
    meta = lambda key: F.regexp_extract(html, rf'(?is)<meta[^>]*(?:property|name)="{key}"[^>]*content="([^"]*)"', 1)
    container = F.regexp_extract(html, r'(?is)<(?:div|section)[^>]*(?:id|class)="[^"]*job-?description[^"]*"[^>]*>([\s\S]*?)</(?:div|section)>', 1)
    long = lambda c: F.when(F.length(c) > 100, c)
    return F.coalesce(F.nullif(F.get_json_object(json_ld_posting(html), "$.description"), F.lit("")), F.nullif(F.trim(container), F.lit("")), long(meta("og:description")), long(meta("description")))


def free_text_pay(text: Column) -> Column:
    """Struct (low, high, currency, interval) of a pay note such as $90k-120k / year; null if it has no amount."""
    amounts = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,.]*\s*[kK]?)"), 1), lambda a: F.regexp_replace(a, r"[,\skK]", "").try_cast("double") * F.when(a.rlike("[kK]"), 1000).otherwise(1))
    amounts = F.array_compact(amounts)
    currency = F.when(text.rlike("(?i)€|eur"), "EUR").when(text.rlike("(?i)£|gbp"), "GBP").when(text.rlike(r"(?i)\$|usd"), "USD")
    period = F.when(text.rlike("(?i)year|annum|annual|/yr"), "year").when(text.rlike("(?i)hour|/hr"), "hour").when(text.rlike("(?i)month"), "month").when(text.rlike("(?i)day"), "day")
    return F.when(F.size(amounts) > 0, F.struct(F.get(amounts, F.lit(0)).alias("low"), F.get(amounts, F.lit(1)).alias("high"), currency.alias("currency"), period.alias("interval")))


def json_ld_pay(html: Column) -> Column:
    """Struct (low, high, currency, interval) of the pay of a page's JSON-LD: bounds, else one value for both; null if it names no amount."""
    ld = json_ld_posting(html)
    get = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object(ld, f"$.baseSalary{p}"), F.lit("")) for p in paths])
    low, high = get(".value.minValue", ".minValue", ".value.value"), get(".value.maxValue", ".maxValue", ".value.value")
    single = F.when(get(".value").rlike(r"^-?[0-9.]+$"), get(".value"))
    # Units of the vocabulary.
    units = F.create_map(*[F.lit(x) for k, v in {"YEAR": "year", "MONTH": "month", "WEEK": "week", "DAY": "day", "HOUR": "hour"}.items() for x in (k, v)])
    low, high = F.coalesce(low, single), F.coalesce(high, single)
    return F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("low"), high.alias("high"), get(".currency").alias("currency"), units[F.upper(get(".value.unitText", ".unitText"))].alias("interval")))


def first_site_wins(pages: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of several sites or shards in one: of rows with one key the one of the lowest order."""
    rest = [c for c in pages.columns if c not in (key, order)]
    return pages.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r")).select(key, "_r.*")


def shard_complete(pages: DataFrame, shard: str, offset: str, count: str, size: int) -> DataFrame:
    """Rows (shard, rows, complete): a shard is complete once its last page is a short one."""
    d = pages.groupBy(shard).agg(F.sum(count).alias("rows"), F.max_by(count, offset).alias("_last"))
    return d.select(shard, "rows", (F.col("_last") < size).alias("complete"))
