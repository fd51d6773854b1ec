"""Relational queries over the job tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweft.functions import classify, names, places, salary, text
from jobweft.functions.patterns import either, sql_first_label, sql_found
from jobweft.operators import changes, matching
from jobweft.operators.merge import POLICIES, Policy, absence, last_of_key, merge, sync_counts
from jobweft.plans import problems, search
from jobweft.session import dealt, table

AS_OF = "2025-06-01 00:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"
WANTED = search.Filters(q="engineer, data analyst, nurses", employment_type="full time, contract, FULL TIME", posted="past-365 days", as_of=AS_OF)
NARROW = search.Filters(work_mode="remote,hybrid", ats=["Workday", "greenhouse"], as_of=AS_OF)
CITY = search.Filters(location="US, umbererhaven", as_of=AS_OF)


def now() -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def jobs(spark: SparkSession, sf: str, where: str | Column | None = None) -> DataFrame:
    """One row per posting. Repeated rows are equal, so the condition goes first, to the scan; columns not used later are not read."""
    d = table(spark, sf, "jobs")
    return (d if where is None else d.where(where)).dropDuplicates(["id"])


def stored(spark: SparkSession, sf: str, where: str | Column | None = None) -> DataFrame:
    """The postings with their repeated rows: what is computed from a row alone is computed first, and its narrow result made distinct."""
    d = table(spark, sf, "jobs")
    return dealt(d if where is None else d.where(where), "id")


def companies(spark: SparkSession, sf: str, where: str | Column | None = None) -> DataFrame:
    d = table(spark, sf, "companies")
    return (d if where is None else d.where(where)).dropDuplicates(["id"])


def newest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "job_snapshots")
    return d.where(F.col("snapshot_no") == d.agg(F.max("snapshot_no")).scalar()).where("removed_at IS NULL")


# search

def search_topk(spark, sf):
    return search.top_k(table(spark, sf, "jobs"), table(spark, sf, "companies"), WANTED)


def search_city(spark, sf):
    return search.top_k(table(spark, sf, "jobs"), table(spark, sf, "companies"), CITY, limit=40, offset=20)


def search_capped_count(spark, sf):
    return search.capped_count(table(spark, sf, "jobs"), WANTED, cap=100)


def search_meta(spark, sf):
    return search.page_meta(search.capped_count(table(spark, sf, "jobs"), search.Filters(as_of=AS_OF), cap=1000), 50, 100)


def facets(spark, sf):
    return search.facets(table(spark, sf, "jobs"))


def facets_filtered(spark, sf):
    return search.facets(table(spark, sf, "jobs"), NARROW)


# joins and aggregates

def directory_counts(spark, sf):
    j = jobs(spark, sf).groupBy("company_id").agg(F.count_if(F.col("removed_at").isNull()).alias("live"), F.count("id").alias("total"))
    return companies(spark, sf).join(j, F.col("id") == F.col("company_id")).select("id", "company_name", "live", "total")


def profile_left_on(spark, sf):
    live = jobs(spark, sf, "removed_at IS NULL").groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"))
    return companies(spark, sf).join(live, F.col("id") == F.col("company_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("live"), "newest")


def company_count(spark, sf):
    return jobs(spark, sf, "removed_at IS NULL AND company_id IS NOT NULL").join(companies(spark, sf).select(F.col("id").alias("company_id")), "company_id", "left_semi").agg(F.count_distinct("company_id").alias("n"))


def two_key_count(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


def semi_live(spark, sf):
    live = jobs(spark, sf, "removed_at IS NULL").select(F.col("company_id").alias("id"))
    return companies(spark, sf).join(live, "id", "left_semi").select("id", "ats")


def anti_processed(spark, sf):
    seen = jobs(spark, sf, "last_checked_at IS NOT NULL").select(F.col("company_id").alias("id"))
    return companies(spark, sf).join(seen, "id", "left_anti").select("id", "ats")


def shared_domain(spark, sf):
    return companies(spark, sf).groupBy(text.registrable_domain(F.lower("domain")).alias("site")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3 AND site <> ''")


def unique_key_join(spark, sf):
    d = companies(spark, sf).select("id", text.clean_domain(F.col("domain")).alias("site"))
    return matching.unique_claims(d, "site", "id")


def dup_key_groups(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("digest")).agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first_doc"))
    return d.where("n > 1")


def cascade_match(spark, sf):
    c = companies(spark, sf)
    board = F.coalesce(F.lower("domain").endswith("jobs.example"), F.lit(False))
    return matching.cascade(c.where(board), c.where(~board), [
        ("name", text.flat_name(F.col("company_name")), text.flat_name(F.col("company_name"))), ("loose", text.loose_name(F.col("company_name")), text.loose_name(F.col("company_name")))], "id", "id")


def prefix_fuzzy(spark, sf):
    return matching.prefix_pairs(companies(spark, sf), "id", text.flat_name(F.col("company_name")))


def nearest_preceding(spark, sf):
    e = table(spark, sf, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return matching.nearest_before(buys, views, "user_id", "ts", "view_id").select("event_id", "user_id", "near_view_id", "near_at")


def domain_survivors(spark, sf):
    return matching.survivors(_weighed(spark, sf), ["site"], "id", "live").withColumnRenamed("survivor", "id")


def _weighed(spark, sf):
    live = jobs(spark, sf, "removed_at IS NULL").groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("live"))
    return companies(spark, sf).select("id", text.clean_domain(F.col("domain")).alias("site")).where("site IS NOT NULL AND NOT endswith(site, 'jobs.example')").join(live, "id", "left").fillna(0, ["live"])


def dedup_overlap(spark, sf):
    w = _weighed(spark, sf)
    keep = matching.survivors(w, ["site"], "id", "live").select("site", F.col("survivor").alias("keeper"))
    losers = w.join(keep, "site").where("id <> keeper").select(F.col("id").alias("company_id"), "keeper")
    live = jobs(spark, sf, "removed_at IS NULL AND external_id IS NOT NULL")
    kept = live.select(F.col("company_id").alias("keeper"), "external_id").distinct()
    return live.join(losers, "company_id").join(kept, ["keeper", "external_id"], "left_semi").select("id", "company_id", "external_id")


def param_grid(spark, sf):
    grid = spark.createDataFrame([(["engineer", "analyst", "nurse"], ["berlin", "remote"], [0, 50])], "roles array<string>, cities array<string>, offsets array<int>")
    return grid.select(F.explode("roles").alias("role"), "cities", "offsets").select("role", F.explode("cities").alias("city"), "offsets").select("role", "city", F.explode("offsets").alias("offset"))


def completeness(spark, sf):
    share = lambda c: F.round(100 * F.count_if(c) / F.count(F.lit(1)), 2)
    return jobs(spark, sf).groupBy(F.lower(F.trim("ats")).alias("ats")).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("description").isNotNull() & ~F.col("description").isin("", "N/A")).alias("description"), share(F.col("location").isNotNull()).alias("location"), share(F.col("salary_min").isNotNull()).alias("salary"))


def absence_histogram(spark, sf):
    return jobs(spark, sf, "removed_at IS NULL").groupBy(F.coalesce("absent_syncs", F.lit(0)).alias("absent")).agg(F.count(F.lit(1)).alias("n")).orderBy("absent").limit(4)


def age_buckets(spark, sf):
    days = F.date_diff(F.lit(AS_OF[:10]).cast("date"), F.col("created_at").cast("date"))
    bucket = F.when(days < 30.44, "under 1").when(days < 91.32, "1 to 3").when(days < 182.64, "3 to 6").otherwise("over 6")
    return jobs(spark, sf).groupBy(bucket.alias("months")).agg(F.count(F.lit(1)).alias("n"))


def retention(spark, sf):
    """Postings older than 90 days by their date, or by when they were first seen where that cannot be read."""
    posted = problems.p3_found(spark, sf).where("field_name = 'posted_at'").groupBy("id").agg(F.max("utc_micros").alias("_us"))
    d = stored(spark, sf).select("id", "created_at").distinct().join(posted, "id", "left").withColumn("at", F.coalesce(F.timestamp_micros("_us").cast("timestamp_ntz"), "created_at"))
    return d.where(F.col("at") < now() - F.expr("INTERVAL '90' DAY")).select("id").distinct()


def modulo_partition(spark, sf):
    return jobs(spark, sf, F.pmod("id", F.lit(8)) == 3).groupBy(F.pmod("company_id", F.lit(8)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


def keyset_page(spark, sf):
    return jobs(spark, sf, "id > 1000").orderBy("id").limit(100).select("id", "title")


def prune_candidates(spark, sf):
    due = F.col("last_checked_at").isNull() | (F.col("last_checked_at") < now() - F.expr("INTERVAL '14' DAY"))
    aged = F.col("created_at") < now() - F.expr("INTERVAL '30' DAY")
    c = companies(spark, sf).select(F.col("id").alias("company_id"), "last_synced_at")
    d = jobs(spark, sf, "removed_at IS NULL").where(due).join(c, "company_id").withColumn("missing", F.coalesce(F.col("last_synced_at") > F.col("last_seen_at"), F.lit(False)))
    return d.where(aged | F.col("missing")).orderBy("id").limit(500).select("id", "company_id", "missing")


def fair_interleave(spark, sf):
    from pyspark.sql import Window

    c = companies(spark, sf, "status = 'active'").where(F.col("last_synced_at").isNull() | (F.col("last_synced_at") < now()))
    # only the first of each board can reach the page, so the window is cut before it is shuffled
    rn = F.row_number().over(Window.partitionBy("ats").orderBy(F.asc_nulls_first("last_synced_at"), "id"))
    return c.select("id", "ats", "last_synced_at", rn.alias("rn")).where("rn <= 100").orderBy("rn", F.asc_nulls_first("last_synced_at"), "id").limit(100).select("id", "ats", "rn")


def last_wins(spark, sf):
    d = table(spark, sf, "job_snapshots").select("company_id", "external_id", "load_seq", "title")
    return last_of_key(d, ("company_id", "external_id"), "load_seq")


def first_wins(spark, sf):
    d = table(spark, sf, "job_snapshots").dropna(subset=["company_id", "external_id"]).groupBy("company_id", "external_id")
    return d.agg(F.min(F.struct("load_seq", "title")).alias("f")).select("company_id", "external_id", "f.*")


def percentile_floor(spark, sf):
    """p50, p90 and greatest length by floor rank: counts of equal lengths first, so no board's rows meet in one task."""
    from pyspark.sql import Window

    lengths = jobs(spark, sf, "description IS NOT NULL").groupBy(F.lower(F.trim("ats")).alias("ats"), F.length("description").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ats").orderBy("len")  # distinct lengths of one board
    d = lengths.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("ats")))
    rank = lambda p: F.greatest(F.floor(F.col("all") * p), F.lit(1))
    return d.groupBy("ats").agg(*[F.min(F.when(F.col("upto") >= rank(p), F.col("len"))).alias(f"p{int(p * 100)}") for p in (0.5, 0.9)], F.max("len").alias("greatest"))


def absence_streaks(spark, sf):
    d = table(spark, sf, "job_snapshots").dropna(subset=["company_id", "external_id"]).groupBy("company_id", "external_id", "snapshot_no").agg(F.max(F.col("removed_at").isNull()).alias("present"))
    return matching.absence_runs(d, ["company_id", "external_id"], "snapshot_no", "present")


def demand_rollup(spark, sf):
    j = stored(spark, sf).select("id", "title", "location", "employment_type", "experience_level", "workplace_type", "is_remote", "created_at").distinct()
    d = j.select(text.demand_key(F.col("title"), F.col("location"), classify.employment_type(F.col("employment_type")), F.col("experience_level"), classify.workplace_type(F.col("workplace_type")), F.col("is_remote")).alias("demand_key"), "id", "created_at").where("demand_key IS NOT NULL")
    return d.groupBy("demand_key").agg(F.count(F.lit(1)).alias("searches"), F.min("id").alias("least"), F.max_by("id", F.struct("created_at", "id")).alias("latest"))


def demand_top(spark, sf):
    return demand_rollup(spark, sf).orderBy(F.desc("searches"), "least", "demand_key").limit(50)


# merges and change capture

def merged(name: str):
    def run(spark, sf):
        d = merge(jobs(spark, sf), newest_snapshot(spark, sf), POLICIES[name], order="load_seq", as_of=now())
        return d.select("id", "company_id", "external_id", "title", "location", "workplace_type", "url", "last_seen_at", "removed_at", "absent_syncs", "_action").withColumnRenamed("_action", "action")

    return run


def sync_metrics(spark, sf):
    return sync_counts(jobs(spark, sf), newest_snapshot(spark, sf))


def absence_counts(spark, sf):
    d = absence(jobs(spark, sf), newest_snapshot(spark, sf), as_of=now())
    return d.groupBy(F.coalesce("absent_syncs", F.lit(0)).alias("absent"), F.col("removed_at").isNull().alias("live")).agg(F.count(F.lit(1)).alias("n"))


def change_capture(spark, sf):
    j = jobs(spark, sf)
    after = merge(j, newest_snapshot(spark, sf), POLICIES["sync"], order="load_seq", as_of=now()).where("id IS NOT NULL")
    return changes.changed_rows(j, after)


def outbox_add(spark, sf):
    return changes.outbox_split(jobs(spark, sf, "last_checked_at IS NOT NULL"))[0]


def outbox_delete(spark, sf):
    return changes.outbox_split(jobs(spark, sf, "last_checked_at IS NOT NULL"))[1]


def dim_fanout(spark, sf):
    return changes.fan_out(jobs(spark, sf), companies(spark, sf).where("index_dirty_at IS NOT NULL OR origin = 'demand'")).select("id", "company_id")


def replicate_delta(spark, sf):
    have = jobs(spark, sf).select("company_id", "external_id")
    return last_of_key(newest_snapshot(spark, sf), ("company_id", "external_id"), "load_seq").join(have, ["company_id", "external_id"], "left_anti").select("company_id", "external_id", "title")


# scalar functions

def normalise_types(spark, sf):
    return stored(spark, sf).select("id", classify.employment_type(F.col("employment_type")).alias("employment"), classify.workplace_type(F.col("workplace_type")).alias("workplace")).distinct()


def types_in_text(spark, sf):
    return stored(spark, sf).select("id", classify.workplace_in_text(F.col("title"), F.col("location"), F.col("description")).alias("workplace"), classify.employment_in_text(F.col("title"), F.col("description")).alias("employment")).distinct()


def classify_remote(spark, sf):
    return stored(spark, sf).select("id", classify.is_remote(F.col("title"), F.col("location"), F.col("workplace_type"), F.col("description")).alias("remote")).distinct()


def classify_worldwide(spark, sf):
    c = F.col
    return stored(spark, sf).select("id", classify.is_worldwide(c("title"), c("location"), c("description"), classify.is_remote(c("title"), c("location"), c("workplace_type"), c("description"))).alias("worldwide")).distinct()


def classify_role(spark, sf):
    return stored(spark, sf).select("id", classify.role_category(F.col("title")).alias("role")).distinct()


def classify_level(spark, sf):
    return stored(spark, sf).select("id", classify.experience_level(F.col("title"), F.col("description")).alias("level")).distinct()


def salary_extract(spark, sf):
    return stored(spark, sf).select("id", salary.salary_in_text(F.coalesce(F.concat_ws(" ", F.lit("Salary:"), "salary_min", F.lit("-"), "salary_max", "description"), F.lit(""))).alias("s")).where("s IS NOT NULL").select("id", "s.*").distinct()


def location_tokens(spark, sf):
    return jobs(spark, sf, "location IS NOT NULL").select("id", F.explode(places.location_tokens(F.col("location"))).alias("token"))


def countries(spark, sf):
    return places.with_countries(jobs(spark, sf), "location", "id")


def search_region(spark, sf):
    live = jobs(spark, sf, "removed_at IS NULL").select("id", "location")
    return places.place_filter(live, "DACH").withColumn("term", F.lit("dach")).unionByName(places.place_filter(live, "United Kingdom").withColumn("term", F.lit("gb")))


def slug_candidates(spark, sf):
    return companies(spark, sf).select("id", F.explode(names.slug_candidates(F.col("company_name"), F.col("domain"))).alias("slug"))


def board_addresses(spark, sf):
    return companies(spark, sf).select("id", names.board_address(F.col("ats"), F.col("ats_slug")).alias("address"))


def company_collapse(spark, sf):
    d = jobs(spark, sf, "company_id IS NOT NULL").groupBy("company_id").agg(F.min_by("title", "id").alias("first_title"), F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url"))
    return d


def employer_variants(spark, sf):
    """Sites whose company names may be spellings of one employer: the shortest and the longest of a site are found first, then every name is tested against them."""
    c = companies(spark, sf).select(text.clean_domain(F.col("domain")).alias("site"), F.col("company_name").alias("name"), text.flat_name(F.col("company_name")).alias("core"))
    c = c.where("site IS NOT NULL AND NOT endswith(site, 'jobs.example') AND core <> ''").distinct()
    ends = c.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.length("core").alias("l"), "core"))["core"].alias("shortest"), F.max(F.struct(F.length("name").alias("l"), "name"))["name"].alias("longest")).where("n > 1")
    same = F.contains("core", "shortest") | F.contains("shortest", "core") | names.is_acronym(F.col("shortest"), F.col("longest"))
    return c.join(ends, "site").groupBy("site").agg(F.first("n").alias("n"), F.bool_and((F.length("shortest") >= 2) & same).alias("one"))


def strip_html(spark, sf):
    return jobs(spark, sf, "description IS NOT NULL").select("id", text.strip_html(F.col("description")).alias("plain"))


def quality_gate(spark, sf):
    return stored(spark, sf).select("id", text.good_description(F.col("description")).alias("good")).distinct()


def url_parts(spark, sf):
    u = F.col("url")
    return stored(spark, sf).select("id", text.host_of(u).alias("host"), text.path_of(u).alias("path"), text.registrable_domain(text.host_of(u)).alias("site"), text.last_segment(u).alias("native_id")).distinct()


def json_path(spark, sf):
    return stored(spark, sf, "raw_data IS NOT NULL").select("id", F.get_json_object("raw_data", "$.board").alias("board"), F.get_json_object("raw_data", "$.v").try_cast("int").alias("v")).distinct()


def index_documents(spark, sf):
    return jobs(spark, sf, "removed_at IS NULL").select(*changes.indexed_document())


JD = "(SELECT DISTINCT ON (id) * FROM jobs)"
CD = "(SELECT DISTINCT ON (id) * FROM companies)"
SNAP = "(SELECT * FROM job_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM job_snapshots) AND removed_at IS NULL)"
EMP_TEXT = "trim(regexp_replace(replace(lower(employment_type), '&amp;', '&'), '[_/]+', ' ', 'g'))"
WORK_TEXT = r"trim(regexp_replace(lower(workplace_type), '[_\-\s]+', ' ', 'g'))"


def _canonical(text_sql: str, nothing: list[str], rules: list[tuple[str, str]]) -> str:
    none = ", ".join(f"'{x}'" for x in nothing)
    return f"CASE WHEN {text_sql} IS NULL OR {text_sql} = '' OR {text_sql} IN ({none}) THEN NULL ELSE {sql_first_label(text_sql, rules, None)} END"


EMP, WORK = _canonical(EMP_TEXT, classify.EMPLOYMENT_NOTHING, classify.EMPLOYMENT_RULES), _canonical(WORK_TEXT, classify.WORKPLACE_NOTHING, classify.WORKPLACE_RULES)
_STEM = r"lambda w: CASE WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN regexp_matches(w, '[a-z]{3}s$') AND NOT w LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"
_TOKENS = rf"list_transform(regexp_extract_all(lower(concat_ws(' ', title, department, location)), '[\p{{L}}\p{{N}}_-]+'), {_STEM})"
PREPARED = f"""(SELECT id, company_id, lower(trim(ats)) AS ats, title, department, location, url, experience_level, created_at, removed_at, random_rank,
  coalesce(is_remote, false) AS is_remote, {WORK} AS workplace, {EMP} AS employment, {_TOKENS} AS search_tokens FROM {JD} AS j)"""
WANTED_SQL = f"""removed_at IS NULL AND (list_contains(search_tokens, 'engineer') OR (list_contains(search_tokens, 'data') AND list_contains(search_tokens, 'analyst')) OR list_contains(search_tokens, 'nurse'))
  AND employment IN ('Contract', 'Full-time') AND created_at >= {NOW} - INTERVAL 365 DAY"""
_LOC = r"regexp_replace(trim(lower(location)), '\s+', ' ', 'g')"
_SEGS = rf"list_filter(list_transform(regexp_split_to_array({_LOC}, '[,/|]|\s+-\s+'), lambda s: trim(regexp_replace(s, '[^a-z0-9'']+', ' ', 'g'))), lambda s: s <> '')"
TOKENS = f"list_distinct(flatten(list_transform({_SEGS}, lambda s: list_concat(CASE WHEN len(string_split(s, ' ')) <= 4 THEN [s] ELSE [] END, list_filter(string_split(s, ' '), lambda w: length(w) > 1)))))"


# names and codes of the countries that the test tables hold, written out apart from the table of the library
_NAMED = {"au": ["australia"], "ca": ["canada"], "de": ["germany", "deutschland"], "es": ["spain"], "fr": ["france"], "gb": ["united kingdom", "great britain", "britain", "england", "scotland", "wales", "northern ireland"],
          "in": ["india"], "nl": ["netherlands", "the netherlands", "holland"], "se": ["sweden"], "us": ["united states", "united states of america", "usa", "america"], "at": ["austria"], "ch": ["switzerland"]}
_STATES = "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc pr vi gu"
_FLATLOC = r"(' ' || trim(regexp_replace(regexp_replace(replace(lower(location), '.', ''), '[^a-z0-9'' ]+', ' ', 'g'), '\s+', ' ', 'g')) || ' ')"
_LOCPARTS = r"list_filter(list_transform(regexp_split_to_array(replace(trim(regexp_replace(lower(location), '\s+', ' ', 'g')), '.', ''), '[,/]|\s+-\s+'), lambda s: trim(s)), lambda s: s <> '')"
_CODE = f"CASE WHEN regexp_full_match({_LOCPARTS}[-1], '[a-z]{{2}}') AND (len({_LOCPARTS}) > 2 OR NOT list_contains(string_split('{_STATES}', ' '), {_LOCPARTS}[-1]) OR {_LOCPARTS}[-1] = {_LOCPARTS}[-2]) THEN {_LOCPARTS}[-1] END"


def _in_country(*codes: str) -> str:
    named = " OR ".join(f"contains({_FLATLOC}, ' {n} ')" for c in codes for n in _NAMED[c])
    return f"({named} OR coalesce({_CODE} IN ({', '.join(repr(c) for c in codes)}), false))"


def _site(host: str) -> str:
    second = ", ".join(f"'{x}'" for x in text.SECOND_LEVELS)
    s = f"string_split({host}, '.')"
    return f"array_to_string(list_slice({s}, greatest(CASE WHEN len({s}) > 2 AND length({s}[len({s})]) = 2 AND {s}[len({s}) - 1] IN ({second}) THEN len({s}) - 2 ELSE len({s}) - 1 END, 1), len({s})), '.')"


CLEAN = r"regexp_replace(regexp_replace(lower(trim(domain)), '^(?:https?://)?(?:www\.)?', ''), '/.*$', '')"
FLAT = "regexp_replace(lower(company_name), '[^a-z0-9]', '', 'g')"
LOOSE = r"regexp_replace(regexp_replace(trim(regexp_replace(lower(company_name), '[,.]', ' ', 'g')), '(?:\s+(?:inc|ltd|llc|gmbh|corp|co|ag|plc|group|holdings))+$', ''), '[^a-z0-9]', '', 'g')"
WEIGHED = f"""(SELECT c.id, {CLEAN} AS site, coalesce(l.live, 0) AS live FROM {CD} c LEFT JOIN (SELECT company_id, count(*) AS live FROM {JD} j WHERE removed_at IS NULL GROUP BY 1) l ON l.company_id = c.id
  WHERE {CLEAN} IS NOT NULL AND NOT ({CLEAN} LIKE '%jobs.example'))"""
SURVIVORS = f"(SELECT site, first(id ORDER BY live DESC, id) AS id, count(*) AS members FROM {WEIGHED} GROUP BY site HAVING count(*) > 1)"
LAST_SNAP = f"(SELECT * FROM {SNAP} s WHERE company_id IS NOT NULL AND external_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id, external_id ORDER BY load_seq DESC) = 1)"


def _merge_sql(policy: Policy, columns: list[str]) -> str:
    have = {"title", "department", "location", "workplace_type", "employment_type", "url", "last_seen_at", "removed_at"}
    out = []
    for c in columns:
        s, n = f"s.{c}", f"n.{c}" if c in have else "NULL"
        if c in ("company_id", "external_id"):
            e = f"coalesce(s.{c}, n.{c})"
        elif c in policy.constants:
            e = f"CASE WHEN n.company_id IS NOT NULL THEN {policy.constants[c]} ELSE {s} END"
        elif c == "last_seen_at":
            e = f"CASE WHEN n.company_id IS NOT NULL THEN {NOW} ELSE {s} END"
        elif c == "removed_at":
            e = f"CASE WHEN n.company_id IS NOT NULL AND s.id IS NOT NULL AND {policy.revive} THEN NULL ELSE {s} END"
        elif c in policy.new and c in have:
            e = f"CASE WHEN n.company_id IS NOT NULL THEN {n} ELSE {s} END"
        elif c in policy.coalesce:
            e = f"coalesce({n}, {s})"
        elif c in policy.fill:
            e = f"coalesce({s}, {n})"
        else:
            e = f"CASE WHEN s.id IS NULL THEN {n} ELSE {s} END"
        out.append(f"{e} AS {c}")
    action = f"CASE WHEN s.id IS NULL THEN 'inserted' WHEN n.company_id IS NOT NULL AND s.removed_at IS NOT NULL AND {policy.revive} THEN 'revived' WHEN n.company_id IS NOT NULL THEN 'updated' ELSE 'kept' END"
    return f"SELECT {', '.join(out)}, {action} AS action FROM {JD} s FULL JOIN {LAST_SNAP} n ON s.company_id = n.company_id AND s.external_id = n.external_id"


_MERGED_COLUMNS = ["id", "company_id", "external_id", "title", "location", "workplace_type", "url", "last_seen_at", "removed_at", "absent_syncs"]
_DEMAND_PART = lambda e: f"nullif(left(lower(regexp_replace(trim({e}), '\\s+', ' ', 'g')), 200), '')"
_DEMAND_PARTS = [_DEMAND_PART("title"), _DEMAND_PART("location"), _DEMAND_PART(EMP), _DEMAND_PART("experience_level"), f"coalesce({_DEMAND_PART(WORK)}, CASE WHEN is_remote THEN 'remote' END)"]
_DEMAND = f"""SELECT concat_ws('|', {', '.join(f"coalesce({p}, '')" for p in _DEMAND_PARTS)}) AS demand_key,
  count(*) AS searches, min(id) AS least, last(id ORDER BY created_at NULLS FIRST, id) AS latest FROM {JD} j WHERE coalesce({', '.join(_DEMAND_PARTS)}) IS NOT NULL GROUP BY 1"""
_DOC = r"""id, company_id, nullif(title, '') AS title, nullif(department, '') AS department, nullif(location, '') AS location, nullif(workplace_type, '') AS workplace_type, nullif(employment_type, '') AS employment_type,
  nullif(url, '') AS url, nullif(ats, '') AS ats, nullif(experience_level, '') AS experience_level, TRY_CAST(regexp_extract(salary_min, '^\s*(-?\d+(?:\.\d+)?)', 1) AS DOUBLE) AS salary_min,
  TRY_CAST(regexp_extract(salary_max, '^\s*(-?\d+(?:\.\d+)?)', 1) AS DOUBLE) AS salary_max, CAST(floor(epoch(created_at)) AS BIGINT) AS first_seen_ts"""
_ABSENT = f"""SELECT j.*, o.company_id IS NOT NULL AND p.company_id IS NULL AND j.removed_at IS NULL AS missed FROM {JD} j
  LEFT JOIN (SELECT company_id FROM {SNAP} s WHERE company_id IS NOT NULL GROUP BY 1 HAVING NOT bool_or(external_id IS NULL)) o ON o.company_id = j.company_id
  LEFT JOIN (SELECT DISTINCT company_id, external_id FROM {SNAP} s WHERE company_id IS NOT NULL AND external_id IS NOT NULL) p ON p.company_id = j.company_id AND p.external_id = j.external_id"""
_TEXT = "concat_ws(' ', coalesce(title, ''), coalesce(location, ''), coalesce(description, ''))"
_HTML = reduce(lambda t, step: f"regexp_replace({t}, '{step[0].replace(chr(39), chr(39) * 2)}', '{step[1].replace(chr(39), chr(39) * 2)}', 'g')", text.HTML_STEPS, "description")
_PLAIN = r"trim(regexp_replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1))"
_RANKED = lambda base: f"CASE WHEN {sql_found('title', classify.SENIOR_WORD)} THEN 'senior' WHEN {sql_found('title', classify.JUNIOR_WORD)} THEN 'entry' ELSE '{base}' END"
_LEVEL = f"""CASE WHEN {sql_found('title', either(*classify.LEVEL_INTERNSHIP))} THEN 'internship' WHEN {sql_found('title', classify.OFFICE_ASSISTANT)} THEN 'entry'
  WHEN {sql_found('title', classify.SALES_REP)} THEN {_RANKED('entry')} WHEN {sql_found('title', either(classify.SALES_EXECUTIVE, classify.IC_MANAGER, classify.BUSINESS_PARTNER))} THEN {_RANKED('mid')}
  WHEN {sql_found('title', either(*classify.LEVEL_ENTRY))} THEN 'entry' WHEN {sql_found('title', either(*classify.LEVEL_EXECUTIVE))} THEN 'executive' WHEN {sql_found('title', either(*classify.LEVEL_SENIOR))} THEN 'senior'
  WHEN {sql_found('title', either(*classify.LEVEL_LEAD))} THEN 'lead' WHEN {sql_found('title', either(*classify.LEVEL_MID))} THEN 'mid'
  WHEN {sql_found('description', either(*classify.LEVEL_INTERNSHIP))} THEN 'internship' WHEN {sql_found('description', either(*classify.LEVEL_ENTRY))} THEN 'entry' END"""
_REMOTE = f"""CASE WHEN lower(coalesce(workplace_type, '')) IN ('remote', 'fully remote', 'fully_remote') THEN true WHEN lower(coalesce(workplace_type, '')) IN ('hybrid', 'on-site', 'onsite', 'in-office') THEN false
  WHEN {sql_found(_TEXT, either(*classify.REMOTE_NO))} THEN false WHEN {sql_found('title', r'\bremote\b')} THEN true WHEN {sql_found('location', r'\bremote\b')} AND NOT {sql_found('location', 'hybrid')} THEN true
  WHEN {sql_found('location', classify.REMOTE_EVERYWHERE)} THEN true ELSE {sql_found(_TEXT, either(*classify.REMOTE_YES))} END"""
_TIED = lambda e: f"({sql_found(e, either(*classify.TIED))} OR regexp_matches(coalesce({e}, ''), '{classify.TIED_CODES}'))"
_PLACE = "trim(coalesce(location, ''))"
_WORLD = f"""CASE WHEN NOT ({_REMOTE}) THEN false WHEN {_TIED('title')} THEN false WHEN length({_PLACE}) >= 2 AND {_TIED(_PLACE)} THEN false
  WHEN {sql_found(_PLACE, r'\banywhere\s+in\b')} AND NOT {sql_found(_PLACE, r'\banywhere\s+in\s+the\s+world\b')} THEN false
  WHEN {sql_found('description', classify.ON_SPOT)} OR {sql_found('title', either(*classify.ON_SPOT_TITLES))} THEN false WHEN {sql_found(_PLACE, classify.WORLD_LOCATION)} THEN true
  WHEN length({_PLACE}) < 3 THEN NOT {sql_found('description', either(*classify.RESTRICTED, classify.ON_SPOT_DAYS))} AND {sql_found('description', either(*classify.WORLD_TEXT))} ELSE false END"""
_WORKTEXT = f"""CASE WHEN {sql_found(_TEXT, classify.TEXT_REMOTE)} THEN CASE WHEN {sql_found(_TEXT, r'\bhybrid\b')} THEN 'hybrid' ELSE 'remote' END
  WHEN {sql_found(_TEXT, classify.TEXT_HYBRID)} THEN 'hybrid' WHEN {sql_found(_TEXT, classify.TEXT_ONSITE)} THEN 'onsite' END"""
_TOP = "h.id, h.title, h.location, h.ats, h.workplace, h.employment, h.created_at, h.company_id, c.company_name"


def _salary_sql(t: str) -> str:
    tries = []
    codes = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**salary.CURRENCIES, **{c: c for c in salary.KNOWN_CODES}}.items())
    for shape, low, high, currency, thousands, interval in salary.SHAPES:
        part = lambda i, p=shape: f"regexp_extract({t}, '{p}', {i})"
        number = lambda i: f"TRY_CAST(replace({part(i)}, ',', '') AS DOUBLE)"  # noqa: E731, B023
        k_low = f"CASE WHEN {part(thousands[0])} <> '' THEN 1000 ELSE 1 END" if thousands else "1"
        k_high = f"CASE WHEN {part(thousands[1])} <> '' OR {part(thousands[0])} <> '' THEN 1000 ELSE 1 END" if thousands else "1"
        at = f"strpos({t}, {part(0)})"
        around = f"lower(substring({t}, greatest({at} - 60, 1), length({part(0)}) + least({at} - 1, 60) + 80))"
        period = f"'{interval}'" if interval else "CASE " + " ".join(f"WHEN regexp_matches({around}, '{p}') THEN '{v}'" for p, v in salary.PERIODS) + " ELSE 'yearly' END"
        code = f"coalesce(CASE upper(coalesce({', '.join(f'nullif({part(i)}, {chr(39) * 2})' for i in currency)})) {codes} END, 'USD')"
        tries.append(f"{{'low': {number(low)} * {k_low}, 'high': {number(high)} * {k_high}, 'currency': {code}, 'interval': {period}}}")
    floors = " ".join(f"WHEN '{k}' THEN {v}" for k, v in salary.FLOORS.items())
    return f"list_filter([{', '.join(tries)}], lambda x: x.low IS NOT NULL AND x.low <= x.high AND x.high <= {salary.CEILING} AND x.low >= CASE x.interval {floors} END)[1]"


_SALARY_TEXT = "concat_ws(' ', 'Salary:', salary_min, '-', salary_max, description)"
_LABELS = r"list_filter(string_split(regexp_replace(regexp_replace(lower(domain), '^https?://', ''), '/.*$', ''), '.'), lambda p: p <> '' AND p <> 'www')"
_SLUG_NAME = rf"trim(regexp_replace(lower(company_name), '\b(?:{names.LEGAL_FORMS})\b', ' ', 'g'))"
_SLUGS = f"""[regexp_replace(CASE WHEN len({_LABELS}) = 1 THEN {_LABELS}[1] WHEN {_LABELS}[len({_LABELS}) - 1] IN ('co', 'com') THEN {_LABELS}[len({_LABELS}) - 2] ELSE {_LABELS}[len({_LABELS}) - 1] END, '[^a-z0-9-]', '', 'g'),
  regexp_replace({_SLUG_NAME}, '[^a-z0-9]', '', 'g'), regexp_replace(regexp_replace({_SLUG_NAME}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')]"""
_NO_SLUGS = ", ".join(f"'{x}'" for x in names.NO_SLUGS)
_INITIALS = r"array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(longest), '[^a-z0-9 ]+', ' ', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ('and', 'of', 'the', 'for', 'a', 'an')), lambda w: left(w, 1)), '')"


def _facets_sql(condition: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS value FROM p" for f in ("ats", "workplace", "employment", "experience_level"))
    return f"WITH p AS (SELECT * FROM {PREPARED} WHERE {condition}) SELECT facet, value, count(*) AS n FROM ({parts}) WHERE value IS NOT NULL AND value <> '' GROUP BY ALL"


def _top_sql(condition: str, limit: int, offset: int) -> str:
    return f"""WITH h AS (SELECT * FROM {PREPARED} WHERE {condition} ORDER BY created_at DESC NULLS LAST, random_rank ASC NULLS LAST, id LIMIT {limit} OFFSET {offset})
      SELECT {_TOP} FROM h LEFT JOIN {CD} c ON c.id = h.company_id"""


QUERIES = {
    f.__name__: f for f in (
        search_topk, search_city, search_capped_count, search_meta, facets, facets_filtered, directory_counts, profile_left_on, company_count, two_key_count, semi_live, anti_processed, shared_domain,
        unique_key_join, dup_key_groups, cascade_match, prefix_fuzzy, nearest_preceding, domain_survivors, dedup_overlap, param_grid, completeness, absence_histogram, age_buckets, retention,
        modulo_partition, keyset_page, prune_candidates, fair_interleave, last_wins, first_wins, percentile_floor, absence_streaks, demand_rollup, demand_top, sync_metrics, absence_counts,
        change_capture, outbox_add, outbox_delete, dim_fanout, replicate_delta, normalise_types, types_in_text, classify_remote, classify_worldwide, classify_role, classify_level, salary_extract, location_tokens,
        countries, search_region, slug_candidates, board_addresses, company_collapse, employer_variants, strip_html, quality_gate, url_parts, json_path, index_documents)
} | {f"merge_{name}": merged(name) for name in POLICIES}

SQL = {
    "search_topk": _top_sql(WANTED_SQL, 50, 0),
    "search_city": _top_sql(f"removed_at IS NULL AND location IS NOT NULL AND ({_in_country('us')} OR list_contains({TOKENS}, 'umbererhaven'))", 40, 20),
    "search_capped_count": f"SELECT least(n, 100) AS total, n > 100 AS is_capped FROM (SELECT count(*) AS n FROM (SELECT id FROM {PREPARED} WHERE {WANTED_SQL} LIMIT 101))",
    "search_meta": f"""SELECT total, is_capped, 3 AS page, CAST(ceil(total / 50.0) AS BIGINT) AS total_pages, 150 < total AS has_next, CASE WHEN 150 < total THEN 150 END AS next_offset, 50 AS prev_offset
      FROM (SELECT least(n, 1000) AS total, n > 1000 AS is_capped FROM (SELECT count(*) AS n FROM (SELECT id FROM {JD} j WHERE removed_at IS NULL LIMIT 1001)))""",
    "facets": _facets_sql("removed_at IS NULL"),
    "facets_filtered": _facets_sql("removed_at IS NULL AND (is_remote OR workplace = 'Hybrid') AND ats IN ('workday', 'greenhouse')"),
    "directory_counts": f"SELECT c.id, c.company_name, count(*) FILTER (j.removed_at IS NULL) AS live, count(j.id) AS total FROM {CD} c JOIN {JD} j ON j.company_id = c.id GROUP BY ALL",
    "profile_left_on": f"SELECT c.id, count(j.id) AS live, max(j.created_at) AS newest FROM {CD} c LEFT JOIN {JD} j ON j.company_id = c.id AND j.removed_at IS NULL GROUP BY c.id",
    "company_count": f"SELECT count(DISTINCT c.id) AS n FROM {CD} c JOIN {JD} j ON j.company_id = c.id WHERE j.removed_at IS NULL",
    "two_key_count": "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL",
    "semi_live": f"SELECT id, ats FROM {CD} c WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.company_id = c.id AND j.removed_at IS NULL)",
    "anti_processed": f"SELECT id, ats FROM {CD} c WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.company_id = c.id AND j.last_checked_at IS NOT NULL)",
    "shared_domain": f"SELECT {_site('lower(domain)')} AS site, count(*) AS n FROM {CD} c WHERE domain IS NOT NULL AND domain <> '' GROUP BY 1 HAVING count(*) >= 3",
    "unique_key_join": f"SELECT {CLEAN} AS site, min(id) AS id FROM {CD} c WHERE domain IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) = 1",
    "dup_key_groups": "SELECT md5(text) AS digest, count(DISTINCT doc_id) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
    "cascade_match": f"""WITH c AS (SELECT id, {FLAT} AS flat, {LOOSE} AS loose, coalesce(lower(domain) LIKE '%jobs.example', false) AS board FROM {CD} x),
      a AS (SELECT flat, min(id) AS id FROM c WHERE NOT board AND flat <> '' GROUP BY 1), b AS (SELECT loose, min(id) AS id FROM c WHERE NOT board AND loose <> '' GROUP BY 1)
      SELECT c.id, coalesce(a.id, b.id) AS match, CASE WHEN a.id IS NOT NULL THEN 'name' ELSE 'loose' END AS how FROM c LEFT JOIN a ON a.flat = c.flat LEFT JOIN b ON b.loose = c.loose WHERE c.board AND coalesce(a.id, b.id) IS NOT NULL""",
    "prefix_fuzzy": f"""WITH c AS (SELECT DISTINCT id, {FLAT} AS n FROM companies WHERE length({FLAT}) >= 10)
      SELECT x.id AS a, y.id AS b FROM c x JOIN c y ON left(x.n, 10) = left(y.n, 10) AND x.id < y.id WHERE starts_with(x.n, y.n) OR starts_with(y.n, x.n)""",
    "nearest_preceding": """SELECT b.event_id, b.user_id, v.view_id AS near_view_id, v.ts AS near_at FROM (SELECT * FROM events WHERE event_type = 'purchase') b
      ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON b.user_id = v.user_id AND b.ts >= v.ts""",
    "domain_survivors": f"SELECT site, id, members FROM {SURVIVORS}",
    "dedup_overlap": f"""SELECT j.id, j.company_id, j.external_id FROM {JD} j JOIN {WEIGHED} w ON w.id = j.company_id JOIN {SURVIVORS} s ON s.site = w.site AND s.id <> w.id
      WHERE j.removed_at IS NULL AND EXISTS (SELECT 1 FROM jobs k WHERE k.removed_at IS NULL AND k.company_id = s.id AND k.external_id = j.external_id)""",
    "param_grid": "SELECT role, city, CAST(o AS INTEGER) AS offset FROM (SELECT unnest(['engineer', 'analyst', 'nurse']) AS role), (SELECT unnest(['berlin', 'remote']) AS city), (SELECT unnest([0, 50]) AS o)",
    "completeness": f"""SELECT lower(trim(ats)) AS ats, count(*) AS n, round(100.0 * count(*) FILTER (description IS NOT NULL AND description NOT IN ('', 'N/A')) / count(*), 2) AS description,
      round(100.0 * count(location) / count(*), 2) AS location, round(100.0 * count(salary_min) / count(*), 2) AS salary FROM {JD} j GROUP BY 1""",
    "absence_histogram": f"SELECT coalesce(absent_syncs, 0) AS absent, count(*) AS n FROM {JD} j WHERE removed_at IS NULL GROUP BY 1 ORDER BY 1 LIMIT 4",
    "age_buckets": f"""SELECT CASE WHEN d < 30.44 THEN 'under 1' WHEN d < 91.32 THEN '1 to 3' WHEN d < 182.64 THEN '3 to 6' ELSE 'over 6' END AS months, count(*) AS n
      FROM (SELECT date_diff('day', CAST(created_at AS DATE), DATE '{AS_OF[:10]}') AS d FROM {JD} j) GROUP BY 1""",
    "retention": f"""SELECT j.id FROM {JD} j LEFT JOIN (SELECT id, max(utc_micros) AS us FROM ({problems.SQL['p3_found']}) WHERE field_name = 'posted_at' GROUP BY 1) p ON p.id = j.id
      WHERE coalesce(make_timestamp(p.us), j.created_at) < {NOW} - INTERVAL 90 DAY""",
    "modulo_partition": f"SELECT company_id % 8 AS part, count(*) AS n, max(id) AS last FROM {JD} j WHERE id % 8 = 3 GROUP BY 1",
    "keyset_page": f"SELECT id, title FROM {JD} j WHERE id > 1000 ORDER BY id LIMIT 100",
    "prune_candidates": f"""SELECT j.id, j.company_id, coalesce(c.last_synced_at > j.last_seen_at, false) AS missing FROM {JD} j JOIN {CD} c ON c.id = j.company_id
      WHERE j.removed_at IS NULL AND (j.last_checked_at IS NULL OR j.last_checked_at < {NOW} - INTERVAL 14 DAY) AND (j.created_at < {NOW} - INTERVAL 30 DAY OR coalesce(c.last_synced_at > j.last_seen_at, false)) ORDER BY j.id LIMIT 500""",
    "fair_interleave": f"""SELECT id, ats, rn FROM (SELECT id, ats, last_synced_at, row_number() OVER (PARTITION BY ats ORDER BY last_synced_at ASC NULLS FIRST, id) AS rn FROM {CD} c
      WHERE status = 'active' AND (last_synced_at IS NULL OR last_synced_at < {NOW})) ORDER BY rn, last_synced_at ASC NULLS FIRST, id LIMIT 100""",
    "last_wins": "SELECT company_id, external_id, load_seq, title FROM job_snapshots WHERE company_id IS NOT NULL AND external_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id, external_id ORDER BY load_seq DESC, title DESC) = 1",
    "first_wins": "SELECT company_id, external_id, load_seq, title FROM job_snapshots WHERE company_id IS NOT NULL AND external_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id, external_id ORDER BY load_seq, title NULLS FIRST) = 1",
    "percentile_floor": f"""WITH r AS (SELECT lower(trim(ats)) AS ats, length(description) AS len, row_number() OVER (PARTITION BY lower(trim(ats)) ORDER BY length(description)) AS rn, count(*) OVER (PARTITION BY lower(trim(ats))) AS n
        FROM {JD} j WHERE description IS NOT NULL)
      SELECT ats, max(len) FILTER (rn = greatest(floor(n * 0.5), 1)) AS p50, max(len) FILTER (rn = greatest(floor(n * 0.9), 1)) AS p90, max(len) AS greatest FROM r GROUP BY ats""",
    "absence_streaks": """WITH d AS (SELECT company_id, external_id, snapshot_no, bool_or(removed_at IS NULL) AS present FROM job_snapshots WHERE company_id IS NOT NULL AND external_id IS NOT NULL GROUP BY ALL),
      g AS (SELECT *, sum(CASE WHEN present THEN 1 ELSE 0 END) OVER (PARTITION BY company_id, external_id ORDER BY snapshot_no) AS seen FROM d),
      r AS (SELECT company_id, external_id, seen, min(snapshot_no) AS run_start, count(*) AS run_length FROM g WHERE NOT present GROUP BY ALL)
      SELECT company_id, external_id, run_start, run_length FROM r QUALIFY row_number() OVER (PARTITION BY company_id, external_id ORDER BY run_length DESC, run_start) = 1""",
    "demand_rollup": _DEMAND,
    "demand_top": f"SELECT * FROM ({_DEMAND}) ORDER BY searches DESC, least, demand_key LIMIT 50",
    "sync_metrics": f"""SELECT count(*) FILTER (l.company_id IS NULL) AS added, count(l.company_id) AS updated, (SELECT count(*) FROM ({_ABSENT}) WHERE missed AND coalesce(absent_syncs, 0) + 1 >= 3) AS removed FROM (SELECT DISTINCT company_id, external_id FROM {SNAP} s WHERE company_id IS NOT NULL AND external_id IS NOT NULL) n
      LEFT JOIN (SELECT DISTINCT company_id, external_id FROM jobs WHERE removed_at IS NULL) l ON l.company_id = n.company_id AND l.external_id = n.external_id""",
    "absence_counts": f"""SELECT CASE WHEN missed THEN coalesce(absent_syncs, 0) + 1 ELSE coalesce(absent_syncs, 0) END AS absent, removed_at IS NULL AND NOT (missed AND coalesce(absent_syncs, 0) + 1 >= 3) AS live, count(*) AS n FROM ({_ABSENT}) GROUP BY ALL""",
    "change_capture": f"""WITH m AS ({_merge_sql(POLICIES['sync'], [*dict.fromkeys(['id', *changes.INDEXED])])})
      SELECT j.id, 'update' AS op FROM {JD} j JOIN m ON m.id = j.id WHERE {' OR '.join(f'j.{c} IS DISTINCT FROM m.{c}' for c in changes.INDEXED)}""",
    "outbox_add": f"SELECT {_DOC} FROM {JD} j WHERE last_checked_at IS NOT NULL AND removed_at IS NULL",
    "outbox_delete": f"SELECT id FROM {JD} j WHERE last_checked_at IS NOT NULL AND removed_at IS NOT NULL",
    "dim_fanout": f"SELECT id, company_id FROM {JD} j WHERE removed_at IS NULL AND company_id IN (SELECT id FROM companies WHERE index_dirty_at IS NOT NULL OR origin = 'demand')",
    "replicate_delta": f"SELECT company_id, external_id, title FROM {LAST_SNAP} n WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.company_id = n.company_id AND j.external_id = n.external_id)",
    "normalise_types": f"SELECT id, {EMP} AS employment, {WORK} AS workplace FROM {JD} j",
    "types_in_text": f"SELECT id, {_WORKTEXT} AS workplace, {sql_first_label('concat_ws(' + chr(39) + ' ' + chr(39) + ', coalesce(title, ' + chr(39) * 2 + '), coalesce(description, ' + chr(39) * 2 + '))', classify.TEXT_EMPLOYMENT, None)} AS employment FROM {JD} j",
    "classify_remote": f"SELECT id, {_REMOTE} AS remote FROM {JD} j",
    "salary_extract": f"SELECT id, s.low, s.high, s.currency, s.interval FROM (SELECT id, {_salary_sql('t')} AS s FROM (SELECT id, {_SALARY_TEXT} AS t FROM {JD} j)) WHERE s IS NOT NULL",
    "slug_candidates": f"SELECT DISTINCT id, slug FROM (SELECT id, unnest({_SLUGS}) AS slug FROM {CD} c) WHERE length(slug) BETWEEN 3 AND 40 AND NOT regexp_matches(slug, '^\\d+$') AND slug NOT IN ({_NO_SLUGS})",
    "employer_variants": f"""WITH c AS (SELECT DISTINCT {CLEAN} AS site, company_name AS name, {FLAT} AS core FROM {CD} x WHERE {CLEAN} IS NOT NULL AND NOT ({CLEAN} LIKE '%jobs.example') AND {FLAT} <> ''),
      e AS (SELECT site, count(*) AS n, first(core ORDER BY length(core), core) AS shortest, first(name ORDER BY length(name) DESC, name DESC) AS longest FROM c GROUP BY 1 HAVING count(*) > 1)
      SELECT site, n, bool_and(length(shortest) >= 2 AND (contains(core, shortest) OR contains(shortest, core) OR (length(shortest) BETWEEN 2 AND 6 AND length({_INITIALS}) >= 2 AND starts_with({_INITIALS}, shortest)))) AS one FROM c JOIN e USING (site) GROUP BY 1, 2""",
    "classify_worldwide": f"SELECT id, {_WORLD} AS worldwide FROM {JD} j",
    "classify_role": f"SELECT id, {sql_first_label('title', classify.ROLE_RULES, 'Other')} AS role FROM {JD} j",
    "classify_level": f"SELECT id, {_LEVEL} AS level FROM {JD} j",
    "countries": " UNION ".join(f"SELECT id, '{c}' AS country FROM jobs WHERE location IS NOT NULL AND {_in_country(c)}" for c in _NAMED),
    "search_region": f"SELECT id, location, 'dach' AS term FROM {JD} j WHERE removed_at IS NULL AND location IS NOT NULL AND {_in_country('de', 'at', 'ch')} UNION ALL SELECT id, location, 'gb' FROM {JD} j WHERE removed_at IS NULL AND location IS NOT NULL AND {_in_country('gb')}",
    "location_tokens": f"SELECT id, unnest({TOKENS}) AS token FROM {JD} j WHERE location IS NOT NULL",
    "board_addresses": f"SELECT id, CASE {' '.join(f"WHEN ats = '{k}' THEN '{v.split('{}')[0]}' || ats_slug || '{v.split('{}')[1]}'" for k, v in names.BOARD_ADDRESSES.items())} ELSE 'https://' || ats_slug || '.com/careers' END AS address FROM {CD} c",
    "company_collapse": f"SELECT company_id, first(title ORDER BY id) AS first_title, count(*) AS n, min(url) AS first_url FROM {JD} j WHERE company_id IS NOT NULL GROUP BY 1",
    "strip_html": rf"SELECT id, regexp_replace({_HTML}, '^\s+|\s+$', '', 'g') AS plain FROM {JD} j WHERE description IS NOT NULL",
    "quality_gate": rf"""SELECT id, coalesce(length({_PLAIN}) >= 300 AND NOT regexp_matches({_PLAIN}, '(?:\.\.\.|…)$') AND NOT regexp_matches({_PLAIN}, '%[A-Z_]+%') AND (length({_PLAIN}) >= 800 OR regexp_matches({_PLAIN}, '[.!?:;)"'']$')), false) AS good FROM {JD} j""",
    "url_parts": rf"""SELECT id, {_HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, {_site(_HOST)} AS site, regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1) AS native_id FROM {JD} j""",
    "json_path": f"SELECT id, raw_data->>'$.board' AS board, TRY_CAST(raw_data->>'$.v' AS INTEGER) AS v FROM {JD} j WHERE raw_data IS NOT NULL",
    "index_documents": f"SELECT {_DOC} FROM {JD} j WHERE removed_at IS NULL",
} | {f"merge_{name}": _merge_sql(policy, _MERGED_COLUMNS) for name, policy in POLICIES.items()}
