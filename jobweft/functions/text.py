"""HTML, URL, JSON and name functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that end a line or a block, and entities, in the order they are replaced.
HTML_STEPS = [
    (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)</li>", "\n"), (r"(?i)<li[^>]*>", "• "), (r"(?i)</h[1-6]>", "\n\n"), (r"<[^>]+>", ""),
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), (r"\n{3,}", "\n\n"),
]
# Labels before which a country's top level has a second level of its own.
SECOND_LEVELS = ["co", "com", "org", "net", "gov", "ac", "edu"]
# Hosts whose first label is the organisation's slug, and hosts whose path begins with it, with the careers page of a slug.
HOST_BOARDS = {
    "myworkdayjobs.com": ("workday", "https://{}.myworkdayjobs.com"), "icims.com": ("icims", "https://{}.icims.com"), "bamboohr.com": ("bamboohr", "https://{}.bamboohr.com"),
    "recruitee.com": ("recruitee", "https://{}.recruitee.com"), "breezy.hr": ("breezy", "https://{}.breezy.hr"), "teamtailor.com": ("teamtailor", "https://{}.teamtailor.com"), "taleo.net": ("taleo", "https://{}.taleo.net"),
}
PATH_BOARDS = {
    "greenhouse.io": ("greenhouse", "https://boards.greenhouse.io/{}"), "lever.co": ("lever", "https://jobs.lever.co/{}"), "ashbyhq.com": ("ashby", "https://jobs.ashbyhq.com/{}"),
    "workable.com": ("workable", "https://apply.workable.com/{}"), "smartrecruiters.com": ("smartrecruiters", "https://jobs.smartrecruiters.com/{}"),
}
# Words of a path that name a section, never an organisation.
SECTIONS = (
    "company companies job jobs job-openings career careers careersection opportunities positions openings talent people team about home index search apply hiring main portal site page default external internal "
    "psc en us www vacancies listings recruiting recruitment employment work join joinus current-openings view list all browse find explore"
).split()
# Addresses of boards inside a page, in the order they are tried, and slugs that are none.
_SLUG = r"""([^/"'?#&\s]+)"""
BOARDS_IN_HTML = [
    ("greenhouse", r"(?:boards|job-boards|api|board-api)\.greenhouse\.io/(?:v1/boards/|embed/job_board/js\?for=)?" + _SLUG), ("greenhouse", r"""greenhouse\.io/[^"']*?(?:board_token|token)=""" + _SLUG),
    ("ashby", r"ashbyhq\.com/(?:posting-api/job-board/)?" + _SLUG), ("lever", r"jobs\.lever\.co/" + _SLUG), ("lever", r"api\.lever\.co/v0/postings/" + _SLUG),
    ("workable", r"apply\.workable\.com/(?:api/v[12]/widget/accounts/)?" + _SLUG), ("recruitee", _SLUG + r"\.recruitee\.com"), ("personio", _SLUG + r"\.jobs\.personio\.(?:de|com)"), ("breezy", _SLUG + r"\.breezy\.hr"),
    ("jazzhr", _SLUG + r"\.applytojob\.com"), ("jazzhr", r"app\.jazz\.co/widgets/basic/create/" + _SLUG), ("workday", _SLUG + r"\.wd\d+\.myworkdayjobs\.com"), ("zoho", _SLUG + r"\.zohorecruit\.(?:com|in|eu)"),
    ("icims", r"careers\." + _SLUG + r"\.com/api/jobs"), ("bamboohr", _SLUG + r"\.bamboohr\.com"), ("taleo", _SLUG + r"\.taleo\.net"), ("pinpoint", _SLUG + r"\.pinpointhq\.com"),
    ("successfactors", r"career" + _SLUG + r"\.successfactors\.(?:eu|com)"),
]
NO_TENANTS = ["www", "api", "app", "cdn", "js", "css", "docs", "support"]


def strip_html(html: Column) -> Column:
    """Plain text: blocks become lines, list items bullets, tags go, six entities are decoded, &amp; first."""
    text = reduce(lambda t, step: F.regexp_replace(t, step[0], step[1]), HTML_STEPS, html)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host, three where the last two are a country's second level."""
    labels = F.split(host, r"\.")
    three = F.get(labels, F.size(labels) - 2).isin(SECOND_LEVELS) & (F.length(F.get(labels, F.size(labels) - 1)) == 2) & (F.size(labels) > 2)
    return F.array_join(F.slice(labels, F.greatest(F.when(three, F.size(labels) - 2).otherwise(F.size(labels) - 1), F.lit(1)), 3), ".")


def last_segment(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/?#]+)/?(?:[?#].*)?$", 1)


def redirected_off(url: Column, final_url: Column, shortest: int = 6) -> Column:
    """True where the last path segment, if long enough to tell, is gone from the final address."""
    segment = last_segment(url)
    return (F.length(segment) >= shortest) & ~F.contains(F.coalesce(final_url, url), segment)


def clean_domain(domain: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), r"^(?:https?://)?(?:www\.)?", ""), r"/.*$", "")


def loose_name(name: Column) -> Column:
    """Letters and digits only, without a closing legal form."""
    plain = F.regexp_replace(F.lower(name), r"[,.]", " ")
    plain = F.regexp_replace(F.trim(plain), r"(?:\s+(?:inc|ltd|llc|gmbh|corp|co|ag|plc|group|holdings))+$", "")
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def flat_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def good_description(text: Column) -> Column:
    """Whether a text can stand as a description: long enough, not cut off, no template left in, closed by a mark if short."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))
    return F.coalesce(
        (F.length(plain) >= 300) & ~plain.rlike(r"(?:\.\.\.|…)$") & ~plain.rlike(r"%[A-Z_]+%") & ((F.length(plain) >= 800) | plain.rlike(r"[.!?:;)\"']$")), F.lit(False))


def demand_part(c: Column) -> Column:
    """A part of a search's key: trimmed, blanks squeezed, lower case, at most 200 characters; null where it says nothing."""
    return F.nullif(F.substring(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), 1, 200), F.lit(""))


def demand_key(query: Column, location: Column, employment: Column, level: Column, mode: Column, remote: Column | None = None) -> Column:
    """Key of a search, its five parts between bars; a search that only browses has none. ``remote`` stands in for a mode that is not given."""
    last = demand_part(mode) if remote is None else F.coalesce(demand_part(mode), F.when(remote, "remote"))
    parts = [*[demand_part(c) for c in (query, location, employment, level)], last]
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def html_to_text(html: Column) -> Column:
    """Text of a page's part: a line for each closing tag of a block, other tags dropped, six entities decoded, blanks squeezed; null for nothing."""
    steps = [(r"(?i)<\s*(?:br|/p|/div|/li)\s*/?>", "\n"), ("<[^>]+>", ""), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#0?39;|&apos;", "'"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]
    text = reduce(lambda t, step: F.regexp_replace(t, step[0], step[1]), steps, html)
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def _at(host: Column, ending: str) -> Column:
    return (host == ending) | host.endswith("." + ending)


def board_of_url(url: Column) -> Column:
    """Struct (ats, slug, careers_url) of the board that an address belongs to; null for a board or slug that it doesn't tell."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    label, first = F.get(F.split(host, r"\."), F.lit(0)), F.get(parts, F.lit(0))
    entry = lambda ats, slug, page: F.when(slug.isNotNull() & (slug != ""), F.struct(F.lit(ats).alias("ats"), slug.alias("slug"), page.alias("careers_url")))
    page = lambda shape, slug: F.concat(F.lit(shape.split("{}")[0]), slug, F.lit(shape.split("{}")[1]))
    guid = F.nullif(F.lower(F.regexp_extract(url, r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)), F.lit(""))
    tenant = F.when(first == "recruiting", F.get(parts, F.lit(1)))
    chain = F.when(_at(host, "tbe.taleo.net"), None)  # another product of that name
    chain = chain.when(_at(host, "paylocity.com"), entry("paylocity", guid, F.concat(F.lit("https://recruiting.paylocity.com/recruiting/jobs/All/"), guid)))
    chain = chain.when(_at(host, "myworkdaysite.com"), entry("workday", tenant, F.concat(F.lit("https://"), host, F.lit("/recruiting/"), tenant)))
    for ending, (ats, shape) in HOST_BOARDS.items():
        chain = chain.when(host.endswith("." + ending), entry(ats, label, page(shape, label)))
    for ending, (ats, shape) in PATH_BOARDS.items():
        chain = chain.when(_at(host, ending), F.when(~F.lower(first).isin(SECTIONS), entry(ats, first, page(shape, first))))
    return chain


def board_in_html(html: Column) -> Column:
    """Struct (ats, slug) of the first board that a page names, in the order of the shapes; slugs of one letter and those of no one are passed over."""
    tries = [(ats, F.regexp_extract(html, pattern, 1)) for ats, pattern in BOARDS_IN_HTML]
    return F.coalesce(*[F.when((F.length(slug) > 1) & ~F.lower(slug).isin(NO_TENANTS), F.struct(F.lit(ats).alias("ats"), slug.alias("slug"))) for ats, slug in tries])


def native_id(url: Column, external_id: Column, ats: Column) -> Column:
    """The board's own id of a posting: where its address holds it, else the stored id without the board's name before it."""
    got = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    # Where the address of each board holds the id.
    uuid = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    own = (
        F.when(ats == "greenhouse", F.coalesce(got(r"[?&]gh_jid=(\d+)"), got(r"/jobs/(\d+)"))).when(ats.isin("lever", "ashby", "rippling"), got(uuid)).when(ats == "smartrecruiters", got(r"/(\d{6,})(?:[-/?#]|$)"))
        .when(ats == "bamboohr", got(r"/careers/(\d+)")).when(ats == "icims", got(r"/jobs/(\d+)")).when(ats == "personio", F.coalesce(got(r"/job/(\d+)"), got(r"-(\d+)(?:[?#/]|$)")))
    )
    return F.coalesce(own, F.replace(F.coalesce(external_id, F.lit("")), F.concat(ats, F.lit("_")), F.lit("")))


def longest_span(html: Column, pattern: str = r'(?is)class="text"[^>]*>([\s\S]*?)</span>', least: int = 200) -> Column:
    """The longest of the spans of a page that are longer than ``least``, the first of equals; null if none is."""
    spans = F.filter(F.regexp_extract_all(html, F.lit(pattern), 1), lambda s: F.length(s) > least)
    return F.trim(F.array_max(F.transform(spans, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"])
