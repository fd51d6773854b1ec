"""Queries of the general data problems over the job tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweft.operators.skew import keys_with_share, salted_aggregate
from jobweft.operators.snapshots import snapshot_changes, stripped
from jobweft.operators.timestamps import MONTHS, SHAPES, ZONE_OFFSETS, utc_instants
from jobweft.operators.units import CURRENCY_SPELLINGS, PERIOD_SPELLINGS, SUFFIX_SCALES, pay_per_year
from jobweft.session import table


def ats_key(c: str = "ats") -> Column:
    return F.lower(stripped(c))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "job_snapshots"))


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p1_found(spark, sf).groupBy("snapshot_no", "change_type").agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return pay_per_year(table(spark, sf, "jobs"), table(spark, sf, "pay_units")).select("id", "bound", "usd_year").distinct()


def p2_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds whose row contradicts itself about a unit; the test tables hold none."""
    return pay_per_year(table(spark, sf, "jobs"), table(spark, sf, "pay_units")).where("non_unique OR residual > 0")


def _instants(spark: SparkSession, sf: str) -> DataFrame:
    sources = table(spark, sf, "ats_sources").select("ats", "time_zone", "day_first")
    zones = [r[0] for r in sources.select("time_zone").where("time_zone IS NOT NULL").distinct().limit(701).collect()]
    jobs = table(spark, sf, "jobs").select("id", "posted_at", "first_seen_at", ats_key().alias("_ats"))
    jobs = jobs.join(sources, jobs["_ats"] == ats_key_of(sources), "left")
    return utc_instants(jobs, {"posted_at": F.col("time_zone"), "first_seen_at": "UTC"}, day_first=F.col("day_first"), zones=zones)


def ats_key_of(sources: DataFrame) -> Column:
    return F.lower(F.trim(sources["ats"]))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _instants(spark, sf).select("id", "field_name", "utc_micros").distinct()


def p3_readings(spark: SparkSession, sf: str) -> DataFrame:
    return _instants(spark, sf).groupBy("field_name", "reading").agg(F.count(F.lit(1)).alias("n"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return keys_with_share(table(spark, sf, "jobs"), {"company_id": F.col("company_id"), "ats": ats_key()}, "id", 0.05)


AGGREGATES = {"n_rows": ("count", "id"), "first_created": ("min", "created_at"), "last_seen": ("max", "last_seen_at"), "absences": ("sum", "absent_syncs")}


def p4_per_company(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "jobs").select("id", "company_id", "created_at", "last_seen_at", "absent_syncs")
    return salted_aggregate(jobs, ["company_id"], AGGREGATES, distinct={"n_jobs": "id"}, heavy_share=0.01)


def p4_per_ats(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "jobs").select("id", ats_key().alias("ats"), "company_id", "created_at", "last_seen_at", "absent_syncs")
    return salted_aggregate(jobs, ["ats"], AGGREGATES, distinct={"n_jobs": "id", "n_companies": "company_id"}, heavy_share=0.01)


QUERIES = {
    "p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p2_flags": p2_flags, "p3_found": p3_found,
    "p3_readings": p3_readings, "p4_found": p4_found, "p4_per_company": p4_per_company, "p4_per_ats": p4_per_ats,
}

_B = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def _sq(c: str) -> str:
    return f"coalesce(trim(regexp_replace({c}, '{_B}+', ' ', 'g')), '')"


_P1 = f"""
WITH k AS (
  SELECT snapshot_no, company_id, regexp_replace(external_id, '^{_B}+|{_B}+$', '', 'g') AS external_id, load_seq, removed_at IS NULL AS live,
         {', '.join(f'{_sq(c)} AS {c}' for c in ('title', 'department', 'location', 'workplace_type', 'employment_type'))}
  FROM job_snapshots WHERE company_id IS NOT NULL AND external_id IS NOT NULL AND snapshot_no IS NOT NULL
), l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY snapshot_no, company_id, external_id ORDER BY load_seq DESC NULLS LAST) = 1),
n AS (SELECT snapshot_no AS cur, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT snapshot_no FROM job_snapshots WHERE snapshot_no IS NOT NULL)),
a AS (SELECT n.cur, l.* FROM l JOIN n ON l.snapshot_no = n.cur WHERE live AND n.prev IS NOT NULL),
b AS (SELECT n.cur, l.* FROM l JOIN n ON l.snapshot_no = n.prev WHERE live)
SELECT coalesce(a.cur, b.cur) AS snapshot_no, coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.external_id, b.external_id) AS external_id,
       CASE WHEN b.cur IS NULL THEN 'added' WHEN a.cur IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM a FULL JOIN b ON a.cur = b.cur AND a.company_id = b.company_id AND a.external_id = b.external_id
WHERE a.cur IS NULL OR b.cur IS NULL OR (a.title, a.department, a.location, a.workplace_type, a.employment_type) IS DISTINCT FROM (b.title, b.department, b.location, b.workplace_type, b.employment_type)
"""


def _pay_sql(conflicts: bool = False) -> str:
    """Pay a year in SQL. Statements that contradict one another, which the test tables don't hold, are taken nearest first rather than reconciled."""
    letters = "a-zà-ɏ"
    clean = lambda c: f"lower(regexp_replace(regexp_replace({c}, '{_B}+', ' ', 'g'), '^ | $', '', 'g'))"

    def first(x: str, spellings: dict[str, str]) -> str:
        """The spelling that starts first: how much text lies before each is compared."""
        found = []
        for code, pattern in spellings.items():
            full = f"(?s)^(|.*?[^{letters}])(?:{pattern})(?:[^{letters}]|$)".replace("'", "''")
            found.append(f"{{'at': CASE WHEN regexp_matches({x}, '{full}') THEN length(regexp_extract({x}, '{full}', 1)) END, 'code': '{code}'}}")
        return f"list_sort(list_filter([{', '.join(found)}], lambda y: y.at IS NOT NULL))[1].code"

    codes = "|".join(c.lower() for c in CURRENCY_SPELLINGS)

    def currency(x: str) -> str:
        bare = f"regexp_replace({x}, '(^|[^a-z])[kt]((?:{codes})(?:[^a-z]|$))', '\\1\\2', 'g')"
        return f"coalesce({first(bare, CURRENCY_SPELLINGS)}, CASE WHEN regexp_matches({bare}, '(^|[^a-z])[a-z]{{1,3}}\\$') THEN 'other' WHEN regexp_matches({bare}, '\\$|(^|[^a-z])dollars?([^a-z]|$)') THEN 'USD' END)"

    # marks between digits: thousands where three digits follow, taken off from one end to the other, then decimals
    number = lambda x: reduce(lambda t, _: f"regexp_replace({t}, '(\\d)[ .,''’](\\d{{3}})(\\D|$)', '\\1\\2\\3', 'g')", range(5), x)
    decimal = lambda x: f"regexp_replace(regexp_replace({x}, '(\\d),(\\d{{1,2}})(\\D|$)', '\\1.\\2\\3', 'g'), '(\\d),(\\d{{1,2}})(\\D|$)', '\\1.\\2\\3', 'g')"
    amount = "(\\d[\\d.,''’]*\\d|\\d)(?: ?(k|lpa|lakhs?|l|crore|cr|mio|m)(?:[^a-z0-9]|$))?"
    amounts = lambda x: f"CASE WHEN regexp_matches({x}, '^-\\d') THEN [] ELSE list_filter(list_transform(range(1, len(regexp_extract_all({x}, '{amount}', 1)) + 1), lambda i: {{'n': regexp_extract_all({x}, '{amount}', 1)[i], 'k': regexp_extract_all({x}, '{amount}', 2)[i]}}), lambda y: regexp_full_match(y.n, '\\d+(\\.\\d+)?')) END"
    suffix = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SUFFIX_SCALES.items())
    scales = {"0.01": "cents?|pence|pennies", "1000": "[kt][a-z]{3}|thousands?|tsd", "100000": "lakhs?|lacs?|lpa", "1000000": "millions?|mio|mn", "10000000": "crores?|cr"}
    field_scale = f"CASE WHEN regexp_matches(cur, '\\(?000s?\\)?') THEN 1000 ELSE CAST(coalesce({first('cur', scales)}, '1') AS DECIMAL(12,2)) END"
    value = lambda b: f"TRY_CAST({b}.n AS DECIMAL(18,4))"
    torn = " AND (len(list_distinct([c_lo, c_cur, c_hi])) > 1 OR len(list_distinct([p_lo, p_per, p_hi])) > 1)" if conflicts else ""
    bound = lambda b, own, other: f"""SELECT id, '{b}' AS bound, CAST({value(b)} * CASE WHEN (CASE WHEN joint THEN greatest(k_min, k_max) ELSE k_{b} END) = 1 THEN fs ELSE (CASE WHEN joint THEN greatest(k_min, k_max) ELSE k_{b} END) END AS DECIMAL(20,4)) AS amount,
        coalesce(c_{own}, c_cur, c_{other}) AS cur, coalesce(p_{own}, p_per, p_{other}) AS per FROM e WHERE {b} IS NOT NULL{torn}"""  # noqa: E731
    return f"""
      WITH a AS (SELECT DISTINCT id, {decimal(number(clean('salary_min')))} AS lo, {decimal(number(clean('salary_max')))} AS hi, {clean('salary_currency')} AS cur, {clean('salary_interval')} AS per FROM jobs WHERE regexp_matches(coalesce(salary_min, '') || coalesce(salary_max, ''), '\\d')),
      b AS (SELECT *, coalesce({amounts('lo')}, []) AS al, coalesce({amounts('hi')}, []) AS ah FROM a),
      c AS (SELECT *, coalesce(al[1], CASE WHEN len(ah) >= 2 THEN ah[1] END) AS min, coalesce(CASE WHEN len(ah) >= 2 THEN ah[2] END, ah[1], al[2]) AS max FROM b),
      d AS (SELECT *, coalesce(CASE min.k {suffix} END, 1) AS k_min, coalesce(CASE max.k {suffix} END, 1) AS k_max, {currency('lo')} AS c_lo, {currency('hi')} AS c_hi, {currency('cur')} AS c_cur,
              {first('lo', PERIOD_SPELLINGS)} AS p_lo, {first('hi', PERIOD_SPELLINGS)} AS p_hi, {first("translate(per, '-_', '  ')", PERIOD_SPELLINGS)} AS p_per, {field_scale} AS fs FROM c),
      e AS (SELECT *, coalesce(least(k_min, k_max) = 1 AND abs(ln(nullif({value('min')}, 0)) - ln(nullif({value('max')}, 0))) < abs(ln(nullif({value('min')}, 0) * k_min) - ln(nullif({value('max')}, 0) * k_max)), false) AS joint FROM d),
      f AS ({bound('min', 'lo', 'hi')} UNION ALL {bound('max', 'hi', 'lo')})
      SELECT DISTINCT f.id, f.bound, CAST(round(CAST(f.amount * CAST(c.factor AS DECIMAL(8,4)) AS DECIMAL(26,6)) * CAST(i.factor AS DECIMAL(8,2)), 0) AS BIGINT) AS usd_year
      FROM f JOIN pay_units c ON c.unit_type = 'currency' AND c.unit_code = f.cur JOIN pay_units i ON i.unit_type = 'interval' AND i.unit_code = f.per WHERE f.amount > 0"""


def _flags_sql() -> str:
    """Rows with two different statements of a currency or a period; what they come to is worked out in the tests, so that a row here would be reported."""
    return f"SELECT id, bound, usd_year, CAST(NULL AS DOUBLE) AS residual, CAST(NULL AS BOOLEAN) AS non_unique FROM ({_pay_sql(conflicts=True)})"


def _times_sql(readings: bool = False) -> str:
    """The reading of timestamps in SQL, with the zone rules of DuckDB's own library; or how many values were read in which way."""
    micros = """CASE WHEN n IS NOT NULL THEN CASE WHEN n < 100000000000 THEN n * 1000000 + us ELSE n * 1000 + CAST(rpad(left(frac, 3), 3, '0') AS BIGINT) END
          WHEN off IS NOT NULL THEN loc - off * CAST(1000000 AS BIGINT) + us
          WHEN timezone(zone, late - INTERVAL 1 HOUR) = make_timestamp(loc) THEN epoch_us(late) - 3600000000 + us ELSE epoch_us(late) + us END"""
    how = """CASE WHEN n IS NOT NULL THEN 'epoch' WHEN off IS NOT NULL THEN 'stated' WHEN timezone(zone, late - INTERVAL 1 HOUR) = make_timestamp(loc) THEN 'ambiguous'
          WHEN timezone(zone, late) = make_timestamp(loc) THEN 'one' ELSE 'skipped' END"""
    text = f"lower(regexp_replace(regexp_replace(text, '{_B}+', ' ', 'g'), '^ | $', '', 'g'))"
    for pattern, line in SHAPES:
        shape = pattern.replace("(?![a-z])", "").replace("'", "''")
        text = f"regexp_replace({text}, '{shape}', '{line.replace('$', chr(92))}')"
    months = ", ".join(f"'{k}': {v}" for k, v in MONTHS.items())
    offsets = ", ".join(f"'{k}': {v}" for k, v in ZONE_OFFSETS.items())
    part = lambda i: f"nullif(f[{i + 1}], '')"
    return f"""
      WITH a AS (SELECT lower(trim(ats)) AS ats, time_zone, day_first FROM ats_sources),
      v AS (SELECT j.id, 'posted_at' AS field_name, j.posted_at AS text, coalesce(a.time_zone, 'UTC') AS zone, coalesce(a.day_first, false) AS day_first FROM jobs j LEFT JOIN a ON {_ATS.replace('ats,', 'j.ats,')} = a.ats
            UNION SELECT j.id, 'first_seen_at', j.first_seen_at, 'UTC', coalesce(a.day_first, false) FROM jobs j LEFT JOIN a ON {_ATS.replace('ats,', 'j.ats,')} = a.ats),
      c AS (SELECT id, field_name, zone, day_first, string_split({text}, '|') AS f FROM v WHERE text IS NOT NULL),
      p AS (SELECT id, field_name, zone, f[1] AS kind, {part(1)} AS head, CASE WHEN f[1] = 'slash' AND day_first THEN {part(3)} ELSE {part(2)} END AS m, TRY_CAST(CASE WHEN f[1] = 'slash' AND day_first THEN {part(2)} ELSE {part(3)} END AS INTEGER) AS d,
              TRY_CAST({part(4)} AS INTEGER) AS h, coalesce(TRY_CAST({part(5)} AS INTEGER), 0) AS mi, coalesce(TRY_CAST({part(6)} AS INTEGER), 0) AS s, coalesce({part(7)}, '') AS frac, {part(8)} AS half, {part(9)} AS z FROM c WHERE len(f) = 10),
      q AS (SELECT *, coalesce(TRY_CAST(m AS INTEGER), map {{{months}}}[left(m, 3)]) AS mon, CASE WHEN half IS NULL THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END AS h24,
              CASE WHEN regexp_matches(z, '^(?:gmt|utc)?[+-]\\d{{2}}:?(?:\\d{{2}})?$') THEN (CAST(regexp_extract(z, '[+-](\\d{{2}})', 1) AS INTEGER) * 3600 + coalesce(TRY_CAST(regexp_extract(z, '[+-]\\d{{2}}:?(\\d{{2}})$', 1) AS INTEGER), 0) * 60) * CASE WHEN contains(z, '-') THEN -1 ELSE 1 END
                ELSE map {{{offsets}}}[z] END AS off, CAST(rpad(left(frac, 6), 6, '0') AS BIGINT) AS us FROM p),
      r AS (SELECT *, CASE WHEN kind <> 'epoch' AND (h IS NULL OR (h24 BETWEEN 0 AND 23 AND mi < 60 AND s < 60)) AND (z IS NULL OR abs(off) <= 50400)
              THEN epoch_us(CAST(TRY_CAST(printf('%04d-%02d-%02d', TRY_CAST(head AS INTEGER), mon, d) AS DATE) AS TIMESTAMP)) + (coalesce(h24, 0) * 3600 + mi * 60 + s) * CAST(1000000 AS BIGINT) END AS loc,
              CASE WHEN kind = 'epoch' THEN TRY_CAST(head AS BIGINT) END AS n FROM q),
      t AS (SELECT *, CASE WHEN loc IS NOT NULL AND off IS NULL THEN timezone(zone, make_timestamp(loc)) END AS late FROM r)
      SELECT DISTINCT id, field_name, {micros} AS utc_micros{f", {how} AS reading" if readings else ""}
      FROM t WHERE n IS NOT NULL OR loc IS NOT NULL"""


_ATS = f"lower(regexp_replace(ats, '^{_B}+|{_B}+$', '', 'g'))"
SQL = {
    "p1_found": _P1,
    "p1_counts": f"SELECT snapshot_no, change_type, count(*) AS n FROM ({_P1}) GROUP BY ALL",
    "p2_found": _pay_sql(),
    "p2_flags": _flags_sql(),
    "p3_found": _times_sql(),
    "p3_readings": f"SELECT field_name, reading, count(*) AS n FROM ({_times_sql(readings=True)}) GROUP BY ALL",
    "p4_found": f"""
      WITH t AS (SELECT count(DISTINCT id) AS total FROM jobs)
      SELECT 'company_id' AS field_name, CAST(company_id AS VARCHAR) AS key_text FROM jobs, t WHERE company_id IS NOT NULL GROUP BY company_id, total HAVING count(DISTINCT id) >= total * 0.05
      UNION ALL
      SELECT 'ats', {_ATS} FROM jobs, t WHERE ats IS NOT NULL GROUP BY 2, total HAVING count(DISTINCT id) >= total * 0.05""",
    "p4_per_company": """SELECT company_id, count(id) AS n_rows, min(created_at) AS first_created, max(last_seen_at) AS last_seen,
      CAST(sum(absent_syncs) AS BIGINT) AS absences, count(DISTINCT id) AS n_jobs FROM jobs GROUP BY company_id""",
    "p4_per_ats": f"""SELECT {_ATS} AS ats, count(id) AS n_rows, min(created_at) AS first_created, max(last_seen_at) AS last_seen,
      CAST(sum(absent_syncs) AS BIGINT) AS absences, count(DISTINCT id) AS n_jobs, count(DISTINCT company_id) AS n_companies FROM jobs GROUP BY 1""",
}
