"""What landed pages of job boards hold: embedded JSON, labelled pairs, microdata, packed fields, sitemaps."""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTITIES = [("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """All named and numeric entities decoded."""
    return text.map(lambda t: None if t is None else _html.unescape(t))


@F.pandas_udf(T.StringType())
def balanced_div(html: pd.Series, name: pd.Series) -> pd.Series:
    """The inside of the first div whose class holds the name, to its own closing tag; a pattern cannot count the divs inside it."""

    def one(text: str | None, cls: str) -> str | None:
        opened = re.search(rf'<div[^>]*class="[^"]*{re.escape(cls)}[^"]*"[^>]*>', text or "", re.I)
        if not opened:
            return None
        depth = 1
        for tag in re.finditer(r"<(/?)div\b[^>]*>", text[opened.end():], re.I):
            depth += -1 if tag[1] else 1
            if depth == 0:
                return text[opened.end() : opened.end() + tag.start()]
        return None

    return pd.Series([one(t, c) for t, c in zip(html, name)])


@F.pandas_udf(T.StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """JSON that a script held in a quoted string: hexadecimal escapes decoded, stray backslashes dropped, doubled ones undone."""

    def one(raw: str | None) -> str | None:
        if raw is None:
            return None
        raw = re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), raw)
        raw = re.sub(r'\\([^"\\/bfnrtu])', r"\1", raw)
        return raw.replace('\\\\"', '\\"').replace("\\\\:", ":").replace("\\\\/", "/")

    return text.map(one)


def script_json(html: Column, variable: str = "jobs") -> Column:
    """The argument of JSON.parse that a variable is set to."""
    return F.nullif(F.regexp_extract(html, rf"var\s+{variable}\s*=\s*JSON\.parse\('(.+?)'\)", 1), F.lit(""))


def hidden_json(html: Column, name: str) -> Column:
    """The value of a hidden input, whatever the order of its attributes, with its entities decoded."""
    either = F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (
        rf'(?is)<input[^>]*(?:id|name)="{name}"[^>]*value="([^"]*)"', rf'(?is)<input[^>]*value="([^"]*)"[^>]*(?:id|name)="{name}"', rf"(?is)<input[^>]*(?:id|name)='{name}'[^>]*value='([^']*)'")])
    for entity, sign in _ENTITIES:
        either = F.regexp_replace(either, entity, sign)
    return either


def microdata(html: Column, prop: str) -> Column:
    """The content of an itemprop, whichever attribute comes first."""
    found = [F.regexp_extract(html, p, 1) for p in (rf"""(?i)itemprop=["']{prop}["'][^>]*?content=["']([^"']*)["']""", rf"""(?i)content=["']([^"']*)["'][^>]*?itemprop=["']{prop}["']""")]
    return F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in found])


def labelled_pairs(html: Column) -> Column:
    """Map of lower-case label to value of the dt and dd elements of a page; the last of equal labels counts, empty ones are left out."""
    pattern = r"(?is)<dt[^>]*>([\s\S]*?)</dt>\s*<dd[^>]*>([\s\S]*?)</dd>"
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    pairs = F.zip_with(F.regexp_extract_all(html, F.lit(pattern), 1), F.regexp_extract_all(html, F.lit(pattern), 2), lambda k, v: F.struct(F.lower(plain(k)).alias("key"), plain(v).alias("value")))
    pairs = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def value_like(pairs: Column, part: str) -> Column:
    """The value of the first label that holds the part."""
    return F.get(F.map_values(F.map_filter(pairs, lambda k, _: k.contains(part))), F.lit(0))


def flex_pay(pairs: Column) -> Column:
    """Struct (low, high, currency) of labelled pay fields; null if neither bound is labelled."""
    # Labels of the bounds.
    low = F.coalesce(*[pairs[k] for k in ("minimum salary", "min salary", "salary minimum")])
    high = F.coalesce(*[pairs[k] for k in ("maximum salary", "max salary", "salary maximum")])
    number = lambda c: F.regexp_extract(F.regexp_replace(c, ",", ""), r"([\d.]+)", 1).try_cast("double")
    code = lambda c: F.nullif(F.regexp_extract(c, "([A-Z]{3})", 1), F.lit(""))
    return F.when(low.isNotNull() | high.isNotNull(), F.struct(number(low).alias("low"), number(high).alias("high"), F.coalesce(code(low), code(high)).alias("currency")))


def packed_fields(text: Column) -> Column:
    """Fields of a text packed between !|! marks; those marked !*! are URL-encoded."""
    return F.transform(F.split(text, r"!\|!"), lambda s: F.when(s.startswith("!*!"), F.try_url_decode(F.regexp_replace(s, r"^!\*!", ""))).otherwise(s))


def sitemap_locations(xml: Column) -> Column:
    """All addresses of a sitemap or of an index of sitemaps."""
    return F.array_distinct(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*([^<]*?)\s*</loc>"), 1), lambda u: F.regexp_replace(u, "&amp;", "&")))


def sitemap_postings(pages: DataFrame, pattern: str) -> DataFrame:
    """Rows (slug, url) of landed sitemaps (slug, url, payload): an index names maps, and all of them that landed are read, one level down."""
    listed = pages.select("slug", "url", F.col("payload").rlike("(?i)<sitemapindex").alias("index"), F.explode(sitemap_locations(F.col("payload"))).alias("loc"))
    below = listed.where("index").select("slug", F.col("loc").alias("map")).distinct()
    own = listed.where("NOT index")
    named = own.join(below, (own["slug"] == below["slug"]) & (own["url"] == below["map"]), "left_semi")
    alone = own.join(below.select("slug").distinct(), "slug", "left_anti")
    return named.unionByName(alone).where(F.col("loc").rlike(pattern)).select("slug", F.col("loc").alias("url")).distinct()


def with_details(listing: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Listing rows with the fields of their detail page; a field of the detail goes before the listing's, a missing detail keeps the row."""
    shared = [c for c in details.columns if c in listing.columns and c != key]
    renamed = details.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_d_{c}") for c in details.columns if c != key]).dropDuplicates(["_key"])
    both = listing.join(renamed, F.col(key) == F.col("_key"), "left")
    own = [F.coalesce(f"_d_{c}", c).alias(c) if c in shared else F.col(c) for c in listing.columns]
    return both.select(*own, *[F.col(f"_d_{c}").alias(c) for c in details.columns if c not in (*shared, key)])


def between_anchors(anchors: Column, marks: Column) -> Column:
    """For each anchor (struct at, value) the last mark that lies behind the anchor before it; null if none does."""
    return F.transform(anchors, lambda a, i: F.struct(
        a["value"].alias("value"), F.array_max(F.filter(marks, lambda m: (m["at"] < a["at"]) & ((i == 0) | (m["at"] > F.get(anchors, i - 1)["at"]))))["value"].alias("mark")))


def most_specific(places: Column) -> Column:
    """The place with the most parts, the first of equals."""
    parts = F.transform(places, lambda p, i: F.struct(F.size(F.split(p, ",")).alias("n"), (-i).alias("i"), p.alias("p")))
    return F.array_max(parts)["p"]


def shard_status(rows: Column, declared: Column) -> Column:
    """Whether a source gave fewer rows than it declares."""
    return F.coalesce(rows < declared, F.lit(False))


def dollar_range(text: Column) -> Column:
    """Struct (low, high) of a $a - $b range of yearly size; null for others."""
    pattern = r"\$([\d,]+(?:\.\d{2})?)\s*[-–]\s*\$([\d,]+(?:\.\d{2})?)"
    low, high = (F.floor(F.regexp_replace(F.regexp_extract(text, pattern, i), ",", "").try_cast("double")) for i in (1, 2))
    return F.when((low >= 10_000) & (high >= 10_000) & (high < 10_000_000), F.struct(low.alias("low"), high.alias("high")))


def structured_workplace(title: Column, location: Column, field: Column) -> Column:
    """onsite, hybrid or remote by the structured fields only; a description never counts."""
    from jobweft.functions.patterns import found

    s = F.concat_ws(" ", title, location, field)
    return (
        F.when(found(s, r"\bnot\s+(?:remote|hybrid)\b"), "onsite").when(found(s, r"\bhybrid\b"), "hybrid")
        .when(found(s, r"\b(?:remote|work from home|wfh|virtual|distributed|anywhere)\b"), "remote").when(found(s, r"\b(?:on-?site|in-?office|in-?person)\b"), "onsite")
    )


def model_answer(content: Column) -> Column:
    """Struct (is_remote, remote_worldwide, visa_sponsorship, experience_level) of a model's answer, null unless all fields are valid; unknown is null."""
    # The values that are valid.
    visa, levels = ("yes", "no", "unknown"), ("internship", "entry", "mid", "senior", "lead", "executive", "unknown")
    text = F.trim(F.regexp_replace(F.regexp_replace(content, r"(?i)```json?\s*", ""), "```", ""))
    a = F.from_json(text, "is_remote boolean, remote_worldwide boolean, visa_sponsorship string, experience_level string")
    valid = a["is_remote"].isNotNull() & a["remote_worldwide"].isNotNull() & a["visa_sponsorship"].isin(*visa) & a["experience_level"].isin(*levels)
    known = lambda c: F.when(c != "unknown", c)
    return F.when(valid, F.struct(a["is_remote"].alias("is_remote"), a["remote_worldwide"].alias("remote_worldwide"), known(a["visa_sponsorship"]).alias("visa_sponsorship"), known(a["experience_level"]).alias("experience_level")))


def vendor_posting(url: Column) -> Column:
    """Struct (vendor, host, tenant, site, id) of the posting addresses of two vendors, each in its host shapes; null for others."""
    from jobweft.functions.text import host_of, path_of

    host, parts = host_of(url), F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    at = lambda name: F.array_position(parts, F.lit(name)).cast("int")
    get = lambda i: F.get(parts, i - 1)
    labels = F.split(host, r"\.")
    path = F.concat(F.lit("/"), F.array_join(F.slice(parts, F.greatest(at("job"), F.lit(1)), F.size(parts) + 1), "/"))
    struct = lambda vendor, tenant, site, key: F.struct(F.lit(vendor).alias("vendor"), host.alias("host"), tenant.alias("tenant"), site.alias("site"), key.alias("id"))
    return (
        F.when(host.rlike(r"^[^.]+\.wd\d+\.myworkdayjobs\.com$") & (at("job") >= 2), struct("workday", F.get(labels, F.lit(0)), get(at("job") - 1), path))
        .when(host.endswith(".myworkdaysite.com") & (F.get(parts, F.lit(0)) == "recruiting") & (at("job") >= 2), struct("workday", F.get(parts, F.lit(1)), get(at("job") - 1), path))
        .when(host.rlike(r"^[^.]+\.fa(?:\.[^.]+)?\.oraclecloud\.com$") & url.startswith("https:") & (at("sites") >= 1) & (at("job") >= at("sites") + 2) & get(at("job") + 1).rlike(r"^\d+$"),
              struct("oracle", F.get(labels, F.lit(0)), get(at("sites") + 1), get(at("job") + 1)))
    )
