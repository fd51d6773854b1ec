"""Whether a posting still stands, by landed answers of its address and by what a browser made of the page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweft.functions.text import last_segment

# Phrases of a page whose posting is gone.
GONE = [
    "this job posting is no longer available", "this position has been filled", "this job is no longer available", "this posting has expired", "job not found", "page not found",
    "position is no longer available", "this requisition is no longer available", "opportunity is no longer available", "this job has been closed", "job has expired",
    "no longer accepting applications", "this role has been filled", "listing has been removed", "sorry, this job is no longer open", "this position is closed",
    "the job you are looking for is no longer available", "this job listing has expired",
]
# Phrases that count besides on a page as a browser shows it.
GONE_RENDERED = [
    "not accepting applications", "we are no longer accepting", "this job is no longer", "this position is no longer available", "this job posting has been closed", "this requisition has been closed",
    "this posting is no longer active", "this opportunity is no longer available", "applications for this position are closed", "this vacancy is closed", "this role is no longer open",
    "the position you are looking for", "this job has expired", "job posting expired",
]
# Phrases of a page that failed, which say nothing of the posting.
NO_EVIDENCE = [
    "access denied", "forbidden", "are you a robot", "captcha", "cloudflare", "rate limit", "too many requests", "temporarily unavailable", "service unavailable", "enable javascript", "please enable",
    "checking your browser", "ddos protection",
]


def _holds(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def answer_verdict(status: Column, url: Column, final_url: Column, html: Column, least_segment: int = 6, short: int = 500) -> Column:
    """True, false or null by an answer: gone by its status, by a redirect that drops the posting, by a phrase, or a short page of an error; null where nothing is known."""
    text = F.lower(F.coalesce(html, F.lit("")))
    segment = F.lower(last_segment(url))
    moved = (F.coalesce(final_url, url) != url) & (F.length(segment) >= least_segment) & ~F.contains(F.lower(F.coalesce(final_url, url)), segment)
    error = (F.length(text) < short) & (F.contains(text, F.lit("sorry")) | F.contains(text, F.lit("error")) | F.contains(text, F.lit("not found")))
    return F.when(status.isin(404, 410), False).when(status.isNull() | ~status.between(200, 299), None).when(moved | _holds(text, GONE) | error, False).otherwise(True)


def rendered_verdict(text: Column, least: int = 200) -> Column:
    """True, false or null by the text of a rendered page: hardly any text or a failed page says nothing, and that is asked first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when((F.length(F.trim(low)) < least) | _holds(low, NO_EVIDENCE), None).when(_holds(low, GONE + GONE_RENDERED), False).otherwise(True)


def two_phase_verdict(answer: Column, rendered: Column) -> Column:
    """An answer that says gone is final; else the rendered page decides."""
    return F.when(~F.coalesce(answer, F.lit(True)), False).otherwise(rendered)


def retire(stored: DataFrame, checks: DataFrame, as_of: Column) -> DataFrame:
    """Stored rows after a round of checks (id, alive): the dead are removed, every checked row is stamped, the others stay as they are."""
    c = checks.groupBy(F.col("id").alias("_id")).agg(F.bool_or(F.coalesce(~F.col("alive"), F.lit(False))).alias("_dead"))
    d = stored.join(c, F.col("id") == F.col("_id"), "left")
    new = {"removed_at": F.when(F.col("_dead") & F.col("removed_at").isNull(), as_of).otherwise(F.col("removed_at")), "last_checked_at": F.when(F.col("_id").isNotNull(), as_of).otherwise(F.col("last_checked_at"))}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in stored.columns])
