"""Further searches, lookups and reports over the job tables, with SQL written out apart from the library's own rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweft.functions import classify, places, text
from jobweft.operators import changes, matching
from jobweft.plans import search
from jobweft.plans.relational import AS_OF, CD, EMP, FLAT, JD, PREPARED, _in_country, companies, jobs, newest_snapshot, now, stored
from jobweft.session import table


def _page(spark: SparkSession, sf: str, filters: search.Filters) -> DataFrame:
    return search.matching(table(spark, sf, "jobs"), filters)


def search_place(spark, sf):
    """A region, a country by a local name, and a misspelt one."""
    return _page(spark, sf, search.Filters(location="Benelux, espana, united arab emirate"))


def search_substring(spark, sf):
    return _page(spark, sf, search.Filters(location="UK, haven", location_mode="substring"))


def search_marks(spark, sf):
    return _page(spark, sf, search.Filters(visa="Yes", experience_level="senior,LEAD", company_id=[1, 2, 3]))


def search_worldwide(spark, sf):
    return _page(spark, sf, search.Filters(remote_worldwide=True))


def search_like(spark, sf):
    return search.named_like(table(spark, sf, "jobs"), table(spark, sf, "companies"), "senior robotics")


def search_name(spark, sf):
    return search.companies_like(table(spark, sf, "companies"), " SoftWare ")


def search_relevant(spark, sf):
    return search.relevant(table(spark, sf, "jobs"), "data engineer", 40)


def api_rows(spark, sf):
    d = search.response(table(spark, sf, "jobs"), table(spark, sf, "companies"))
    return d.select("id", "is_remote", "visa_sponsorship", "experience_level", F.col("salary.min").alias("pay_min"), F.col("salary.currency").alias("pay_currency"), F.col("company.id").alias("company_id"), F.col("company.name").alias("company_name"))


def estimated_count(spark, sf):
    """Rows of the whole table, which a columnar file answers from its footers."""
    return table(spark, sf, "jobs").agg(F.count(F.lit(1)).alias("n"))


def id_window(spark, sf):
    return stored(spark, sf, "id > 500 AND id <= 900").select("id", "ats").distinct()


def name_groups(spark, sf):
    """Companies whose board and name, whatever its case, stand for several rows: the groups are joined back."""
    c = companies(spark, sf).where("company_name IS NOT NULL AND ats IS NOT NULL").select("id", "ats", F.lower("company_name").alias("slug"))
    many = c.groupBy("ats", "slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return c.join(many, ["ats", "slug"], "left_semi")


def first_urls(spark, sf):
    """Each company's number of postings and the first four of their addresses, by a bounded list that is merged, never a whole group."""
    d = stored(spark, sf, "company_id IS NOT NULL AND url IS NOT NULL").select("company_id", "id", "url").distinct()
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("company_id").orderBy("id"))
    top = d.withColumn("r", rank).where("r <= 4").groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "url"))), lambda x: x["url"]), " ").alias("urls"))
    return d.groupBy("company_id").agg(F.count_distinct("id").alias("n")).join(top, "company_id")


def shared_names(spark, sf):
    """Sites that four companies or more use, or two whose names differ in letters and digits."""
    c = companies(spark, sf).select(text.clean_domain(F.col("domain")).alias("site"), text.flat_name(F.col("company_name")).alias("flat")).where("site IS NOT NULL AND site <> ''")
    d = c.groupBy("site").agg(F.count(F.lit(1)).alias("n"), (F.min("flat") != F.max("flat")).alias("differ"))
    return d.where("n >= 4 OR differ").select("site", "n", F.coalesce("differ", F.lit(False)).alias("differ"))


def sibling_slugs(spark, sf):
    """For each company the slugs of others on the same board with its name or its domain: two equi joins, not one with OR."""
    c = companies(spark, sf).select("id", "ats", "ats_slug", "company_name", "domain")
    other = c.where("ats_slug IS NOT NULL").select(F.col("id").alias("o"), F.col("ats").alias("oa"), F.col("ats_slug").alias("slug"), F.col("company_name").alias("on_"), F.col("domain").alias("od"))
    same = lambda a, b: c.join(other, (F.col("ats") == F.col("oa")) & (F.col(a) == F.col(b))).where("id <> o").select("id", "slug")
    return same("company_name", "on_").unionByName(same("domain", "od")).distinct()


def keyset_down(spark, sf):
    """The page before a key, newest first, and where the table is at its end the first page again."""
    d = stored(spark, sf).select("id", "title").distinct()
    page = d.where("id < 40").orderBy(F.desc("id")).limit(60)
    more = d.where("id >= 40").orderBy(F.desc("id")).limit(60)
    both = page.withColumn("turn", F.lit(0)).unionByName(more.withColumn("turn", F.lit(1)))
    return both.orderBy("turn", F.desc("id")).limit(60)


def active_first(spark, sf):
    c = companies(spark, sf)
    return c.orderBy(F.desc(F.coalesce(F.col("status") == "active", F.lit(False))), F.desc_nulls_last("last_synced_at"), "id").limit(80).select("id", "status", "last_synced_at")


def newest_by_board(spark, sf):
    return stored(spark, sf).select(F.lower(F.trim("ats")).alias("ats"), "created_at", "id").distinct().orderBy("ats", F.desc("created_at"), "id").limit(90)


def enriched_first(spark, sf):
    """The fullest rows of a bounded window of ids."""
    fields = ("description", "department", "location", "salary_min", "employment_type")
    score = sum((F.coalesce(F.col(c) != "", F.lit(False)).cast("int") for c in fields), F.lit(0))
    return jobs(spark, sf, "id BETWEEN 1 AND 1000").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(30)


def matched_titles(spark, sf):
    return stored(spark, sf, F.col("title").rlike("(?i)^(senior|lead) ") & ~F.col("title").rlike("(?i)nurse|clerk")).select("id", "title").distinct()


def dedup_retired(spark, sf):
    """Companies after their duplicates on one domain are retired: the survivor stays as it is."""
    from jobweft.plans.relational import _weighed

    w = _weighed(spark, sf)
    keep = matching.survivors(w, ["site"], "id", "live").select("site", F.col("survivor").alias("keeper"))
    gone = w.join(keep, "site").where("id <> keeper").select("id", F.lit(True).alias("_gone"))
    return companies(spark, sf).join(gone, "id", "left").select("id", F.when(F.col("_gone"), "inactive").otherwise(F.col("status")).alias("status"))


def store_delta(spark, sf):
    """Rows of the newest snapshot that cannot be stored, with the reason."""
    bad = changes.quarantined(newest_snapshot(spark, sf).select("company_id", "external_id", "title"), ("company_id", "external_id"), ("title",), most_bytes=40)[1]
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def index_arrays(spark, sf):
    """The derived arrays of index documents, as rows: tokens and countries of a posting's location."""
    live = jobs(spark, sf, "removed_at IS NULL AND location IS NOT NULL").select("id", "location")
    tokens = live.select("id", F.lit("token").alias("kind"), F.explode(places.location_tokens(F.col("location"))).alias("value"))
    return tokens.unionByName(places.with_countries(live, "location", "id").select("id", F.lit("country").alias("kind"), F.col("country").alias("value")))


def outbox_cleared(spark, sf):
    """Stamps that are left after the oldest five were taken up."""
    d = companies(spark, sf).where("index_dirty_at IS NOT NULL").select("id", "index_dirty_at")
    batch = d.orderBy("index_dirty_at", "id").limit(5)
    return changes.cleared(d, batch).where("index_dirty_at IS NOT NULL").select("id")


def classified(spark, sf):
    """All categories of a posting at once."""
    c = F.col
    remote = classify.is_remote(c("title"), c("location"), c("workplace_type"), c("description"))
    d = stored(spark, sf).select("id", remote.alias("remote"), classify.is_worldwide(c("title"), c("location"), c("description"), remote).alias("worldwide"), classify.experience_level(c("title"), c("description")).alias("level"))
    return d.distinct().groupBy("remote", "worldwide", "level").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    search_place, search_substring, search_marks, search_worldwide, search_like, search_name, search_relevant, api_rows, estimated_count, id_window, name_groups, first_urls, shared_names, sibling_slugs, keyset_down, active_first,
    newest_by_board, enriched_first, matched_titles, dedup_retired, store_delta, index_arrays, outbox_cleared, classified)}

from jobweft.plans.relational import _REMOTE, _LEVEL, _WORLD, CLEAN, LAST_SNAP, SNAP, SURVIVORS, TOKENS, WEIGHED, SQL as _SQL  # noqa: E402, I001

_FULL = " + ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN 1 ELSE 0 END" for c in ("description", "department", "location", "salary_min", "employment_type"))
_STEMS = r"list_transform(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_-]+'), lambda w: CASE WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN regexp_matches(w, '[a-z]{{3}}s$') AND NOT w LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)"
SQL = {
    "search_place": f"SELECT id FROM {JD} j WHERE removed_at IS NULL AND location IS NOT NULL AND ({_in_country('nl')} OR {_in_country('es')})",
    "search_substring": f"""SELECT id FROM {JD} j WHERE removed_at IS NULL AND (contains(lower(location), 'united kingdom') OR contains(lower(location), 'great britain') OR contains(lower(location), 'britain')
      OR regexp_matches(location, '(^|[^A-Za-z0-9_])uk([^A-Za-z0-9_]|$)', 'i') OR contains(lower(location), 'haven'))""",
    "search_marks": f"SELECT id FROM {JD} j WHERE removed_at IS NULL AND lower(visa_sponsorship) = 'yes' AND lower(experience_level) IN ('senior', 'lead') AND company_id IN (1, 2, 3)",
    "search_worldwide": f"SELECT id FROM {JD} j WHERE removed_at IS NULL AND ({_WORLD.replace(_REMOTE, 'coalesce(is_remote, false)')})",
    "search_like": f"""SELECT j.id FROM {JD} j LEFT JOIN {CD} c ON c.id = j.company_id WHERE j.removed_at IS NULL AND (contains(lower(coalesce(title, '')), 'senior') OR contains(lower(coalesce(department, '')), 'senior') OR contains(lower(coalesce(company_name, '')), 'senior'))
      AND (contains(lower(coalesce(title, '')), 'robotics') OR contains(lower(coalesce(department, '')), 'robotics') OR contains(lower(coalesce(company_name, '')), 'robotics'))""",
    "search_name": f"SELECT id, company_name FROM {CD} c WHERE company_name ILIKE '%software%'",
    "search_relevant": f"""WITH p AS (SELECT id, title, created_at, {_STEMS.format("concat_ws(' ', title, department, location)")} AS a, {_STEMS.format("coalesce(title, '')")} AS t FROM {JD} j WHERE removed_at IS NULL),
      s AS (SELECT id, title, created_at, CAST(list_contains(a, 'data') AS INT) + CAST(list_contains(a, 'engineer') AS INT) AS found, CAST(list_contains(t, 'data') AS INT) + CAST(list_contains(t, 'engineer') AS INT) AS in_title, len(t) = 2 AS exact FROM p)
      SELECT id, title, found, in_title, exact FROM s WHERE found > 0 ORDER BY found DESC, in_title DESC, exact DESC, created_at DESC NULLS LAST, id LIMIT 40""",
    "api_rows": f"""SELECT j.id, coalesce(is_remote, false) AS is_remote, nullif(visa_sponsorship, '') AS visa_sponsorship, nullif(experience_level, '') AS experience_level, salary_min AS pay_min, salary_currency AS pay_currency, c.id AS company_id, company_name
      FROM {JD} j LEFT JOIN {CD} c ON c.id = j.company_id""",
    "estimated_count": "SELECT count(*) AS n FROM jobs",
    "id_window": "SELECT DISTINCT id, ats FROM jobs WHERE id > 500 AND id <= 900",
    "name_groups": f"SELECT id, ats, lower(company_name) AS slug FROM {CD} c WHERE (ats, lower(company_name)) IN (SELECT (ats, lower(company_name)) FROM {CD} d WHERE company_name IS NOT NULL AND ats IS NOT NULL GROUP BY ats, lower(company_name) HAVING count(*) > 1)",
    "first_urls": f"""SELECT company_id, count(*) AS n, array_to_string(list_slice(list(url ORDER BY id), 1, 4), ' ') AS urls FROM {JD} j WHERE company_id IS NOT NULL AND url IS NOT NULL GROUP BY 1""",
    "shared_names": f"SELECT site, count(*) AS n, coalesce(min(flat) <> max(flat), false) AS differ FROM (SELECT {CLEAN} AS site, {FLAT} AS flat FROM {CD} c) WHERE site <> '' GROUP BY site HAVING count(*) >= 4 OR min(flat) <> max(flat)",
    "sibling_slugs": f"SELECT DISTINCT c.id, o.ats_slug AS slug FROM {CD} c JOIN {CD} o ON c.ats = o.ats AND c.id <> o.id AND (c.company_name = o.company_name OR c.domain = o.domain) WHERE o.ats_slug IS NOT NULL",
    "keyset_down": "SELECT id, title, CASE WHEN id < 40 THEN 0 ELSE 1 END AS turn FROM (SELECT DISTINCT id, title FROM jobs) ORDER BY turn, id DESC LIMIT 60",
    "active_first": f"SELECT id, status, last_synced_at FROM {CD} c ORDER BY coalesce(status = 'active', false) DESC, last_synced_at DESC NULLS LAST, id LIMIT 80",
    "newest_by_board": f"SELECT lower(trim(ats)) AS ats, created_at, id FROM {JD} j ORDER BY 1 NULLS FIRST, created_at DESC, id LIMIT 90",
    "enriched_first": f"SELECT id, {_FULL} AS score FROM {JD} j WHERE id BETWEEN 1 AND 1000 ORDER BY score DESC, id LIMIT 30",
    "matched_titles": "SELECT DISTINCT id, title FROM jobs WHERE title SIMILAR TO '(?i)(senior|lead) .*' AND NOT regexp_matches(title, 'nurse|clerk', 'i')",
    "dedup_retired": f"SELECT c.id, CASE WHEN s.id <> c.id THEN 'inactive' ELSE status END AS status FROM {CD} c LEFT JOIN {WEIGHED} w ON w.id = c.id LEFT JOIN {SURVIVORS} s ON s.site = w.site",
    "store_delta": f"SELECT CASE WHEN company_id IS NULL OR external_id IS NULL THEN 'null key' ELSE 'text too long' END AS reason, count(*) AS n FROM {SNAP} s WHERE company_id IS NULL OR external_id IS NULL OR octet_length(encode(coalesce(title, ''))) > 40 GROUP BY 1",
    "index_arrays": f"SELECT id, 'token' AS kind, unnest({TOKENS}) AS value FROM {JD} j WHERE removed_at IS NULL AND location IS NOT NULL UNION ALL SELECT c.id, 'country', country FROM ({_SQL['countries']}) c WHERE c.id IN (SELECT id FROM jobs WHERE removed_at IS NULL)",
    "outbox_cleared": f"""WITH d AS (SELECT id, index_dirty_at FROM {CD} c WHERE index_dirty_at IS NOT NULL), b AS (SELECT * FROM d ORDER BY index_dirty_at, id LIMIT 5)
      SELECT id FROM d WHERE id NOT IN (SELECT id FROM b) OR index_dirty_at > (SELECT max(index_dirty_at) FROM b)""",
    "classified": f"SELECT remote, worldwide, level, count(*) AS n FROM (SELECT id, {_REMOTE} AS remote, {_WORLD} AS worldwide, {_LEVEL} AS level FROM {JD} j) GROUP BY ALL",
}
