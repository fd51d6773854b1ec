"""Countries and searchable tokens of location texts."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Other names of countries.
COUNTRY_ALIASES = {
    "us": ["usa", "u.s.", "u.s.a.", "america", "united states of america"],
    "gb": ["uk", "u.k.", "britain", "great britain", "england", "scotland", "wales", "northern ireland"],
    "ae": ["uae", "emirates"], "nl": ["holland", "the netherlands"], "de": ["deutschland"], "kr": ["korea", "republic of korea"], "kp": ["dprk"],
    "ru": ["russian federation"], "cz": ["czech republic"], "ci": ["ivory coast"], "mm": ["burma"], "cv": ["cape verde"], "sz": ["swaziland"], "mk": ["macedonia"],
    "va": ["vatican", "holy see"], "tl": ["east timor"], "vn": ["viet nam"], "tr": ["turkiye"], "sy": ["syrian arab republic"],
    "cd": ["democratic republic of the congo", "congo-kinshasa"], "cg": ["republic of the congo", "congo-brazzaville"], "tw": ["republic of china"], "tz": ["united republic of tanzania"],
    "bo": ["plurinational state of bolivia"], "ve": ["bolivarian republic of venezuela"], "ir": ["islamic republic of iran"], "la": ["lao people's democratic republic"], "md": ["republic of moldova"],
}
# First names of countries that the rule of country_table doesn't give, and codes of territories that are no country here.
COUNTRY_NAMES = {
    "cd": "dr congo", "cg": "congo", "ci": "cote d'ivoire", "cv": "cabo verde", "cz": "czechia", "mk": "north macedonia", "mm": "myanmar", "mo": "macao", "ps": "palestine", "sz": "eswatini",
    "tr": "turkey", "vc": "saint vincent and the grenadines", "vi": "us virgin islands", "va": "vatican city", "tl": "timor-leste", "hk": "hong kong",
}
NO_COUNTRIES = frozenset("ai aq as ax bl bq bv cc ck cx fk gs hm io mf mp nf nu pm pn sh sj sx tf tk um wf yt".split())
# Local and misspelt names, and the name that is looked for instead.
SPELLINGS = {
    "espana": "spain", "deutschland": "germany", "osterreich": "austria", "suisse": "switzerland", "schweiz": "switzerland", "italia": "italy", "brasil": "brazil", "mexico": "mexico",
    "nippon": "japan", "nihon": "japan", "holland": "netherlands", "the netherlands": "netherlands", "slowaki": "slovakia", "slowakia": "slovakia", "british colombia": "british columbia",
    "phillipines": "philippines", "philipines": "philippines", "singapor": "singapore", "south korea": "korea, republic of", "united arab emirate": "united arab emirates",
    "england": "united kingdom", "scotland": "united kingdom", "wales": "united kingdom", "britain": "united kingdom", "great britain": "united kingdom",
}
# Codes of the states and territories of the United States.
US_STATES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc pr vi gu"
).split()
# Groups of names that a search takes for one another.
ALIAS_GROUPS = [
    ["united states", "united states of america", "usa", "us", "america"], ["united kingdom", "great britain", "britain", "uk"],
    ["united arab emirates", "emirates", "uae"], ["netherlands", "holland"], ["germany", "deutschland"],
]
# Regions of the world as country codes.
_EU = "at be bg hr cy cz dk ee fi fr de gr hu ie it lv lt lu mt nl pl pt ro sk si es se"
_APAC = "au nz sg jp in cn kr hk tw my th ph id vn"
_LATAM = "mx br ar cl co pe uy cr pa gt ec do"
REGIONS = {
    "european union": _EU, "eu": _EU,
    "europe": "gb ie de fr es it nl be pt se dk no fi is pl cz at ch gr ro hu sk bg hr si lt lv ee lu mt cy ua rs",
    "emea": "gb ie de fr es it nl be se dk no fi pl cz at ch pt gr ro hu ae sa il tr eg za ng ke ma",
    "north america": "us ca mx", "central america": "mx gt bz sv hn ni cr pa", "south america": "br ar cl co pe uy py bo ec ve",
    "latin america": _LATAM, "latam": _LATAM, "americas": "us ca mx br ar cl co pe cr pa uy", "apac": _APAC, "asia pacific": _APAC,
    "apj": "au nz sg jp in kr hk tw my th ph id vn", "asia": "in cn jp kr sg hk tw my th ph id vn ae sa il pk bd", "southeast asia": "sg my th ph id vn kh la mm",
    "anz": "au nz", "australia and new zealand": "au nz", "middle east": "ae sa il qa kw bh om jo lb tr", "mena": "ae sa il qa kw bh om jo lb eg ma tn dz",
    "gcc": "ae sa qa kw bh om", "africa": "za ng ke eg gh ma tz ug rw et sn ci", "nordics": "se no dk fi is", "scandinavia": "se no dk", "benelux": "nl be lu",
    "dach": "de at ch", "uki": "gb ie", "uk and ireland": "gb ie",
}


def country_table(spark: SparkSession) -> dict[str, str]:
    """Name, alias or code to lower-case code. Names are the runtime's English ones made plain: no accents, marks, abbreviations or words in brackets; those above go before."""
    locale = spark._jvm.java.util.Locale
    names = {}
    for code in (c.lower() for c in locale.getISOCountries()):
        if code not in NO_COUNTRIES:
            own = COUNTRY_NAMES.get(code) or re.sub(r"\bst\. ", "saint ", re.sub(r"\s*\(.*?\)| sar china$", "", unaccented(locale("", code.upper()).getDisplayCountry(locale.ENGLISH)).lower())).replace("&", "and")
            names[squeezed_key(own)] = names[code] = code
    for code, aliases in COUNTRY_ALIASES.items():
        names |= {squeezed_key(a): code for a in aliases}
    return names


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def squeezed_key(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip().lower())


def resolve_country(spark: SparkSession, term: str) -> str | None:
    return country_table(spark).get(squeezed_key(term))


def region_codes(term: str) -> list[str]:
    """Country codes of a region's name, whatever its accents, quotes and marks; none if it is no region."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c))
    return REGIONS.get(squeezed_key(re.sub(r"[^a-z ]+", " ", plain.lower())), "").split()


def canonical_spelling(term: str) -> str | None:
    return SPELLINGS.get(squeezed_key(unaccented(term)))


def place_condition(location: Column, term: str, spark: SparkSession) -> Column:
    """Whether a location is what a term means: in the country it names, else in the region, else a known other spelling of either, else with it among its tokens; more than four words are looked for as they stand."""
    codes = [c] if (c := resolve_country(spark, term)) else region_codes(term)
    plain = squeezed_key(term)
    if not codes and (fixed := canonical_spelling(term)):
        codes, plain = [c] if (c := resolve_country(spark, fixed)) else [], fixed
    if codes:
        return in_countries(location, codes, country_table(spark))
    match = F.array_contains(location_tokens(location), plain)
    return match | F.contains(F.lower(location), F.lit(plain)) if len(plain.split()) > 4 else match


def place_filter(jobs: DataFrame, term: str, *, location: str = "location") -> DataFrame:
    """The rows that a location term means."""
    return jobs.where(F.coalesce(place_condition(F.col(location), term, jobs.sparkSession), F.lit(False)))


def _words(location: Column) -> Column:
    """The words of a location: dots dropped, anything but plain letters, digits and apostrophes between them."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.lower(location)), r"\s+", " "), r"\.", "")
    return F.filter(F.split(F.regexp_replace(text, "[^a-z0-9' ]+", " "), r"\s+"), lambda w: w != "")


def _last_code(location: Column) -> Column:
    """A two-letter code at the end, which is no bare state of the United States unless it is written twice; null if there is none."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.lower(location)), r"\s+", " "), r"\.", "")
    parts = F.filter(F.transform(F.split(text, r"[,/]|\s+-\s+"), lambda s: F.trim(s)), lambda s: s != "")
    last, before = F.get(parts, F.size(parts) - 1), F.get(parts, F.size(parts) - 2)
    bare = (F.size(parts) <= 2) & last.isin(US_STATES)
    return F.when(last.rlike("^[a-z]{2}$") & (~bare | F.coalesce(last == before, F.lit(False))), last)


def in_countries(location: Column, codes: list[str], table: dict[str, str]) -> Column:
    """Whether a location names one of the countries, by the rule of with_countries, without a join."""
    spelt = F.concat(F.lit(" "), F.array_join(_words(location), " "), F.lit(" "))
    names = sorted(n for n, c in table.items() if c in codes and len(n) > 2 and re.fullmatch("[a-z0-9' ]+", n) and len(n.split()) <= 4)
    named = F.lit(False)
    for n in names:
        named = named | F.contains(spelt, F.lit(f" {n} "))
    return named | F.coalesce(_last_code(location).isin(*codes), F.lit(False))


def location_tokens(location: Column) -> Column:
    """Segments of up to four words, and their words of two letters or more; no repeats."""
    text = F.regexp_replace(F.trim(F.lower(location)), r"\s+", " ")
    segments = F.transform(F.split(text, r"[,/|]|\s+-\s+"), lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9']+", " ")))
    tokens = F.flatten(F.transform(F.filter(segments, lambda s: s != ""), lambda s: F.concat(
        F.when(F.size(F.split(s, " ")) <= 4, F.array(s)).otherwise(F.array().cast("array<string>")), F.filter(F.split(s, " "), lambda w: F.length(w) > 1))))
    return F.coalesce(F.array_distinct(tokens), F.array().cast("array<string>"))


def with_countries(df: DataFrame, location: str, key: str, out: str = "country") -> DataFrame:
    """Rows (key, country), distinct: countries that a location names.

    Names count anywhere, as whole words of up to four; a two-letter code counts only at the end, and in
    a text of one or two parts not if it is a state of the United States, unless it is written twice.
    """
    spark = df.sparkSession
    names = spark.createDataFrame(sorted(country_table(spark).items()), "name string, code string")
    base = df.where(F.col(location).isNotNull()).select(F.col(key), _words(F.col(location)).alias("_w"), _last_code(F.col(location)).alias("_code")).where(F.size("_w") > 0)
    grams = F.flatten(F.transform(F.array(*[F.lit(n) for n in range(1, 5)]), lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: i + n - 1 <= F.size("_w")), lambda i: F.array_join(F.slice("_w", i, n), " "))))
    named = base.select(key, F.explode(F.array_distinct(grams)).alias("name")).where(F.length("name") > 2)
    coded = base.where("_code IS NOT NULL").join(names.where("name = code"), F.col("_code") == F.col("name")).select(key, F.col("code").alias(out))
    return named.join(names, "name").select(key, F.col("code").alias(out)).unionByName(coded).distinct()
