"""Names of organisations, their slugs and board addresses, and small safety tests of addresses and images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweft.functions.text import host_of

# Legal forms that are no part of a slug, and slugs that stand for no one.
LEGAL_FORMS = "inc|llc|ltd|limited|corp|corporation|co|gmbh|plc|sa|bv|ag|pty|group|holdings"
NO_SLUGS = ["jobs", "careers", "www", "job", "career", "company", "home", "about"]
# Board addresses, with the slug's place marked.
BOARD_ADDRESSES = {
    "greenhouse": "https://boards.greenhouse.io/{}", "lever": "https://jobs.lever.co/{}", "ashby": "https://jobs.ashbyhq.com/{}", "workable": "https://apply.workable.com/{}",
    "recruitee": "https://{}.recruitee.com", "smartrecruiters": "https://careers.smartrecruiters.com/{}", "rippling": "https://ats.rippling.com/{}", "personio": "https://{}.jobs.personio.de",
    "breezy": "https://{}.breezy.hr", "jazzhr": "https://app.jazz.co/widgets/basic/create/{}", "workday": "https://{}.myworkdayjobs.com", "zoho": "https://{}.zohorecruit.com/jobs/Careers",
    "icims": "https://careers.{}.com", "oracle": "https://{}.oraclecloud.com", "bamboohr": "https://{}.bamboohr.com/careers", "taleo": "https://{}.taleo.net", "pinpoint": "https://{}.pinpointhq.com",
    "successfactors": "https://{}",
}


def board_address(board: Column, slug: Column) -> Column:
    """The address of a slug's board, its own careers page for a board without a template."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, shape in BOARD_ADDRESSES.items():
        before, after = shape.split("{}")
        chain = chain.when(board == name, F.concat(F.lit(before), slug, F.lit(after)))
    return chain.otherwise(F.concat(F.lit("https://"), slug, F.lit(".com/careers")))


def slug_candidates(name: Column, domain: Column) -> Column:
    """Slugs that a board may know an organisation by: the label of its domain, its name written together and with hyphens."""
    host = F.regexp_replace(F.regexp_replace(F.lower(domain), r"^https?://", ""), "/.*$", "")
    labels = F.filter(F.split(host, r"\."), lambda p: (p != "") & (p != "www"))
    second = F.get(labels, F.size(labels) - 2)
    label = F.when(F.size(labels) == 1, F.get(labels, F.lit(0))).when(second.isin("co", "com"), F.get(labels, F.size(labels) - 3)).otherwise(second)
    clean = F.trim(F.regexp_replace(F.lower(name), rf"\b(?:{LEGAL_FORMS})\b", " "))
    slugs = F.array(F.regexp_replace(label, "[^a-z0-9-]", ""), F.regexp_replace(clean, "[^a-z0-9]", ""), F.regexp_replace(F.regexp_replace(clean, "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    return F.array_distinct(F.filter(F.array_compact(slugs), lambda s: F.length(s).between(3, 40) & ~s.rlike(r"^\d+$") & ~s.isin(NO_SLUGS)))


def initials(name: Column) -> Column:
    """First letters of the words of a name, small words left out."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " "), r"\s+"), lambda w: (w != "") & ~w.isin("and", "of", "the", "for", "a", "an"))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def is_acronym(short: Column, long: Column) -> Column:
    letters = initials(long)
    return F.length(short).between(2, 6) & (F.length(letters) >= 2) & F.startswith(letters, F.lower(short))


def one_employer(names: Column) -> Column:
    """Whether all names of an array may be spellings of one: each holds the shortest, is held by it, or the shortest is the initials of the longest."""
    core = F.transform(F.filter(names, lambda n: n.isNotNull() & (F.trim(n) != "")), lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9]", ""))
    sized = F.transform(core, lambda c: F.struct(F.length(c).alias("n"), c.alias("c")))
    shortest = F.array_min(sized)["c"]
    longest = F.array_max(F.transform(names, lambda n: F.struct(F.length(n).alias("n"), n.alias("c"))))["c"]
    return F.when(F.size(core) < 2, F.size(core) == 1).otherwise((F.length(shortest) >= 2) & F.forall(core, lambda c: c.contains(shortest) | shortest.contains(c) | is_acronym(shortest, longest)))


def best_name(names: Column) -> Column:
    """The fullest spelling of an array of structs (name, jobs): the longest, then the one with the most jobs."""
    return F.array_max(F.transform(names, lambda n: F.struct(F.length(n["name"]).alias("l"), n["jobs"].alias("j"), n["name"].alias("n"))))["n"]


def public_https(url: Column) -> Column:
    """Whether an address may be asked for: https, a dotted name, no raw number, no inner host."""
    host = host_of(url)
    return F.coalesce(F.lower(url).startswith("https://") & host.rlike(r"^[a-z0-9-]+(?:\.[a-z0-9-]+)+$") & ~host.rlike(r"^\d+\.\d+\.\d+\.\d+$") & ~host.rlike(r"(?:^|\.)(?:localhost|local|internal|localdomain)$"), F.lit(False))


def image_type(data: Column) -> Column:
    """The type of an image by its first bytes; null for anything else."""
    head = F.hex(F.substring(data, 1, 12))
    text = F.ltrim(F.try_validate_utf8(F.substring(data, 1, 300).cast("string")))
    return (
        F.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("474946"), "image/gif")
        .when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").when(head.startswith("00000100"), "image/x-icon")
        .when(text.startswith("<svg") | (text.startswith("<?xml") & text.contains("<svg")), "image/svg+xml")
    )


def usable_image(data: Column, placeholders: list[str]) -> Column:
    """Whether an image is large enough and not a known placeholder, by its digest."""
    return (F.length(data) >= 200) & ~F.md5(data).isin(placeholders or [""])


def best_icon(icons: Column) -> Column:
    """The best of structs (url, apple, px): an .ico last, then apple touch icons, then the largest; the first of equals."""
    ranked = F.transform(icons, lambda x, i: F.struct((~x["url"].rlike(r"(?i)\.ico(?:\?|$)")).alias("a"), x["apple"].alias("b"), x["px"].alias("c"), (-i).alias("d"), x["url"].alias("url")))
    return F.array_max(ranked)["url"]


def truncated_bytes(text: Column, most: int = 2600) -> Column:
    """At most so many bytes of UTF-8, never half a character."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, most)
    # drop the bytes of a character that was cut: at most three, and a first byte
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*[F.try_validate_utf8(F.substring(cut, 1, most - k).cast("string")) for k in range(4)]))


def rotated(items: Column, by: Column) -> Column:
    """An array turned so that it begins at a place, counted around."""
    n = F.greatest(F.size(items), F.lit(1))
    at = F.pmod(by, n)
    return F.concat(F.slice(items, at + 1, n), F.slice(items, F.lit(1), at))
