"""Search over live postings: composable filters, newest first, capped counts, facets and paging."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweft.functions import classify
from jobweft.functions.patterns import found
from jobweft.functions.places import ALIAS_GROUPS, place_condition
from jobweft.functions.windows import within

# Spellings under which a work mode may be stored.
MODES = {"hybrid": ("Hybrid",), "onsite": ("Onsite",), "remote": ("Remote",)}


def listed(value: str | Sequence[str] | None) -> list[str]:
    """A text of values between commas, or a list: trimmed, without repeats whatever their case, the first spelling kept."""
    parts = value.split(",") if isinstance(value, str) else list(value or [])
    seen: dict[str, str] = {}
    for p in (str(x).strip() for x in parts):
        if p:
            seen.setdefault(p.lower(), p)
    return list(seen.values())


def stem(word: Column) -> Column:
    """A plural's singular; nothing else is stemmed."""
    return F.regexp_replace(F.regexp_replace(word, "ies$", "y"), "(?<=[a-z]{3})(?<!s)s$", "")


def tokens(*columns: str) -> Column:
    text = F.lower(F.concat_ws(" ", *columns))
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_-]+"), 0), stem)


def text_match(query: str, tokens_: Column) -> Column | None:
    """Commas part roles, any of which may match; all words of a role must occur."""
    roles = [[w for w in re.sub(r"[^\w-]+", " ", role.lower()).split()] for role in query.split(",")]
    roles = [r for r in roles if r]
    if not roles:
        return None
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.array_contains(tokens_, stem(F.lit(w))) for w in r]) for r in roles])


@dataclass(frozen=True)
class Filters:
    """Any value of a field may match, all fields given must. Unknown employment types alone filter nothing."""

    q: str | None = None
    work_mode: str | Sequence[str] | None = None
    employment_type: str | Sequence[str] | None = None
    experience_level: str | Sequence[str] | None = None
    location: str | Sequence[str] | None = None
    posted: str | None = None
    remote: bool | None = None
    remote_worldwide: bool | None = None
    visa: str | None = None
    company_id: int | Sequence[int] | None = None
    ats: str | Sequence[str] | None = None
    as_of: str = "2025-06-01 00:00:00"
    location_mode: str = "tokens"

    def condition(self) -> Column:
        """Columns needed: those of prepared()."""
        parts = [F.col("removed_at").isNull()]
        if self.q and (text := text_match(self.q, F.col("search_tokens"))) is not None:
            parts.append(text)
        if modes := [m.lower() for m in listed(self.work_mode) if m.lower() in MODES]:
            parts.append(reduce(lambda a, b: a | b, [F.col("is_remote") if m == "remote" else F.col("workplace").isin(*MODES[m]) for m in modes]))
        if kinds := sorted({k for e in listed(self.employment_type) if (k := canonical_employment(e))}):
            parts.append(F.col("employment").isin(*kinds))
        if levels := listed(self.experience_level):
            parts.append(F.lower("experience_level").isin(*[x.lower() for x in levels]))
        if places := listed(self.location):
            parts.append(reduce(lambda a, b: a | b, [self._place(p.lower()) for p in places]))
        parts.append(within(F.col("created_at"), self.posted, self.as_of))
        if self.remote:
            parts.append(F.col("is_remote"))
        if self.remote_worldwide:
            parts.append(F.col("remote_worldwide"))
        if self.visa:
            parts.append(F.lower("visa_sponsorship") == self.visa.strip().lower())
        if self.company_id is not None:
            parts.append(F.col("company_id").isin(*([self.company_id] if isinstance(self.company_id, int) else self.company_id)))
        if boards := listed(self.ats):
            parts.append(F.col("ats").isin(*[b.lower() for b in boards]))
        return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), parts)

    def _place(self, place: str) -> Column:
        group = next((g for g in ALIAS_GROUPS if place in g), [place])
        if self.location_mode == "substring":
            return reduce(lambda a, b: a | b, [found(F.col("location"), rf"\b{re.escape(p)}\b") if len(p) <= 4 and len(group) > 1 else F.contains(F.lower("location"), F.lit(p)) for p in group])
        return place_condition(F.col("location"), place, SparkSession.active())


def canonical_employment(value: str) -> str | None:
    """The canonical type of a filter's value, by the rules of the column."""
    text = re.sub("[_/]+", " ", value.lower()).strip()
    return next((label for pattern, label in classify.EMPLOYMENT_RULES if re.search(pattern, text)), None)


def prepared(jobs: DataFrame) -> DataFrame:
    """Postings with the derived columns that the filters read; in production they are written once, at load."""
    return jobs.select(
        "id", "company_id", F.lower(F.trim("ats")).alias("ats"), "title", "department", "location", "url", "experience_level", "created_at", "removed_at", "random_rank",
        F.coalesce("is_remote", F.lit(False)).alias("is_remote"), "visa_sponsorship", *([F.coalesce("remote_worldwide", F.lit(False)).alias("remote_worldwide")] if "remote_worldwide" in jobs.columns else [
            classify.is_worldwide(F.col("title"), F.col("location"), F.col("description"), F.coalesce("is_remote", F.lit(False))).alias("remote_worldwide")]),
        classify.workplace_type(F.col("workplace_type")).alias("workplace"),
        classify.employment_type(F.col("employment_type")).alias("employment"), tokens("title", "department", "location").alias("search_tokens"))


def matching(jobs: DataFrame, filters: Filters, *columns: str) -> DataFrame:
    """One row per matching posting. Repeated rows are equal, so they are dropped last, when few and narrow."""
    return prepared(jobs).where(filters.condition()).select("id", *columns).distinct()


def top_k(jobs: DataFrame, companies: DataFrame, filters: Filters, limit: int = 50, offset: int = 0) -> DataFrame:
    """The newest postings that match, ties by their random rank and id, with the company's name. The heavy columns are never read."""
    shown = ("title", "location", "ats", "workplace", "employment", "created_at", "company_id")
    hits = matching(jobs, filters, *shown, "random_rank").orderBy(F.desc_nulls_last("created_at"), F.asc_nulls_last("random_rank"), "id").offset(offset).limit(min(limit, 200))
    names = companies.dropDuplicates(["id"]).select(F.col("id").alias("company_id"), "company_name")
    return hits.join(names, "company_id", "left").select("id", *shown, "company_name")


def named_like(jobs: DataFrame, companies: DataFrame, query: str) -> DataFrame:
    """(id) of live postings with each term of a query in title, department or the company's name, as they stand: the way without a text index."""
    terms = [t for t in re.split(r"[\s,]+", query.lower()) if t]
    names = companies.dropDuplicates(["id"]).select(F.col("id").alias("company_id"), "company_name")
    d = jobs.where("removed_at IS NULL").select("id", "company_id", "title", "department").join(names, "company_id", "left")
    text = lambda t: reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(t)), F.lit(False)) for c in ("title", "department", "company_name")])
    return d.where(reduce(lambda a, b: a & b, [text(t) for t in terms], F.lit(True))).select("id").distinct()


def companies_like(companies: DataFrame, query: str) -> DataFrame:
    """Companies whose name holds the query, whatever its case."""
    return companies.where(F.contains(F.lower("company_name"), F.lit(query.strip().lower()))).select("id", "company_name").distinct()


def relevant(jobs: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The best matches of a query: most of its words found, then those of the title, then the title nothing but the query, then the newest; ties by id.

    A posting with none of the words is no match. Words are compared as in text_match.
    """
    words = [w for w in re.sub(r"[^\w-]+", " ", query.lower()).split()]
    live = jobs.where("removed_at IS NULL").select("id", "title", "department", "location", "created_at").distinct()
    stems = [stem(F.lit(w)) for w in words]
    hits = lambda t: reduce(lambda a, b: a + b, [F.array_contains(t, w).cast("int") for w in stems])
    d = live.withColumns({"_all": tokens("title", "department", "location"), "_title": tokens("title")}).withColumns({"found": hits(F.col("_all")), "in_title": hits(F.col("_title")), "exact": F.size("_title") == len(words)})
    d = d.where("found > 0").orderBy(F.desc("found"), F.desc("in_title"), F.desc("exact"), F.desc_nulls_last("created_at"), "id").limit(limit)
    return d.select("id", "title", "found", "in_title", "exact")


def response(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings as a service answers them: amounts as text, missing marks false, company and pay nested."""
    c = companies.dropDuplicates(["id"]).select(F.col("id").alias("company_id"), F.struct("id", F.col("company_name").alias("name"), "domain", "ats_slug", "logo_url").alias("company"))
    pay = F.struct(F.col("salary_min").cast("string").alias("min"), F.col("salary_max").cast("string").alias("max"), F.col("salary_currency").alias("currency"), F.col("salary_interval").alias("interval")).alias("salary")
    d = jobs.dropDuplicates(["id"]).join(c, "company_id", "left")
    return d.select("id", "external_id", "title", "location", F.coalesce("is_remote", F.lit(False)).alias("is_remote"), F.nullif("visa_sponsorship", F.lit("")).alias("visa_sponsorship"), F.nullif("experience_level", F.lit("")).alias("experience_level"), pay, "company")


def capped_count(jobs: DataFrame, filters: Filters, cap: int = 1000) -> DataFrame:
    """One row (total, is_capped): counting stops behind the cap."""
    n = matching(jobs, filters).limit(cap + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(cap)).alias("total"), (F.col("n") > cap).alias("is_capped"))


def facets(jobs: DataFrame, filters: Filters | None = None, by: Sequence[str] = ("ats", "workplace", "employment", "experience_level")) -> DataFrame:
    """Rows (facet, value, n) over the matching postings, all facets in one pass; nulls are left out."""
    hits = matching(jobs, filters or Filters(), *by)
    long = hits.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in by])).alias("f")).select("f.*")
    return long.where("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def page_meta(total: DataFrame, limit: int, offset: int) -> DataFrame:
    """Paging arithmetic beside a row with a total."""
    t = F.col("total")
    return total.select(
        t, "is_capped", (F.lit(offset // limit + 1)).alias("page"), F.ceil(t / limit).alias("total_pages"), (F.lit(offset + limit) < t).alias("has_next"),
        F.when(F.lit(offset + limit) < t, F.lit(offset + limit)).alias("next_offset"), F.when(F.lit(offset > 0), F.lit(max(0, offset - limit))).alias("prev_offset"))


FILTER_FIELDS = [f.name for f in fields(Filters)]
