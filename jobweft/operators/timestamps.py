"""Timestamps of many formats, precisions and zones as one exact UTC instant.

A text is read into a local time and, if it names one, an offset. A local time without an offset is
joined as-of to the zone's offset intervals, exploded to one entry per zone and local year: two matching
intervals mean an ambiguous time, none a skipped one, and one gives the offset directly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweft.operators.snapshots import BLANKS, stripped

# Offsets in seconds of zone abbreviations.
ZONE_OFFSETS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 3600, "bst": 3600, "cet": 3600, "mez": 3600, "cest": 7200, "mesz": 7200,
    "eet": 7200, "eest": 10800, "msk": 10800, "est": -18000, "edt": -14400, "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600,
    "pst": -28800, "pdt": -25200, "ist": 19800, "jst": 32400, "kst": 32400, "sgt": 28800, "aest": 36000, "aedt": 39600, "acst": 34200,
    "acdt": 37800, "awst": 28800, "nzst": 43200, "nzdt": 46800, "akst": -32400, "akdt": -28800, "hst": -36000,
}
# Month names by their first three letters, in English, German, French and Spanish.
MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fév": 2, "fev": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "avr": 4, "abr": 4, "may": 5, "mai": 5,
    "jun": 6, "jul": 7, "aug": 8, "aoû": 8, "ago": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12, "déc": 12, "dic": 12,
}
# Month names that are looked up first, by four letters, as three don't tell them apart.
LONG_MONTHS = {"juin": 6, "juil": 7}
# No zone changed its offset before the first year; after the second all follow yearly rules.
RULE_YEARS = (1840, 2099)
# 28 years with all 14 calendars, for the yearly rules.
MODEL_YEARS = (2372, 2399)

_TIME = r"(?:(?:t|,? at |, ?| )(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([ap])\.?m\.?(?![a-z]))?)?"
_ZONE = r" ?((?:gmt|utc)?[+-]\d{2}:?\d{0,2}|[a-z]{1,5})?(?: ?\([^)]*\))?"
_DAY = r"(?:[a-zäöüé]{2,9}\.?,? )?"
#: Shape, pattern on squeezed lower-case text, and the canonical line  kind|year|month|day|hour|minute|second|fraction|am-pm|zone
SHAPES = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME + _ZONE + "$", "ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})[t ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?()" + _ZONE + "$", "ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})[t ](\d{2})(\d{2})()()()" + _ZONE + "$", "ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _TIME + _ZONE + "$", "slash|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})" + _TIME + _ZONE + "$", "ymd|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (r"^" + _DAY + r"(\d{1,2})(?:st|nd|rd|th|\.)?[- ](?:de )?([a-zäéû]{3,10})\.?[- ,]{1,2}(?:de )?(\d{4})" + _TIME + _ZONE + "$", "ymd|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (r"^" + _DAY + r"([a-zäéû]{3,10})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + _TIME + _ZONE + "$", "ymd|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{1,13})(?:\.(\d*))?$", "epoch|$1||||||$2||"),
]


def offset_intervals(zone: str, first: int, last: int) -> list[tuple[datetime, datetime, int]]:
    """(UTC from, UTC to, offset in seconds) of a zone over a span of years, to the second."""
    tz = ZoneInfo(zone)
    offset = lambda t: int(tz.utcoffset(t.replace(tzinfo=UTC).astimezone(tz).replace(tzinfo=tz, fold=t.replace(tzinfo=UTC).astimezone(tz).fold)).total_seconds())
    start, end = datetime(first, 1, 1) - timedelta(days=2), datetime(last + 1, 1, 1) + timedelta(days=2)
    t, here, began, out = start, offset(start), start, []
    while t < end:
        step = min(t + timedelta(days=7), end)
        if (there := offset(step)) != here:
            lo, hi = t, step
            while hi - lo > timedelta(seconds=1):
                mid = (lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)).replace(microsecond=0)
                lo, hi = (mid, hi) if offset(mid) == here else (lo, mid)
            out.append((began, hi, here))
            began, here, step = hi, there, hi
        t = step
    return [*out, (began, end, here)]


#: The rows of the 14 calendars have this and more as their year.
_CALENDARS = 100_000


def zone_years(spark: SparkSession, zones: list[str], first: int = 1970, last: int = 2069) -> DataFrame:
    """One row per zone and local year with the array of its offset intervals: local_from, local_to, offset (seconds).

    All years before ``first`` share the row of the year before it; years after ``last``, and after the last
    with rules of its own, have a row for each of the 14 calendars, in seconds from the start of the year.
    """
    epoch = datetime(1970, 1, 1)
    rows, done = [], set()
    last = max(last, RULE_YEARS[1])
    for zone in zones:
        try:
            spans, early, late = offset_intervals(zone, first, last), offset_intervals(zone, min(first - 1, RULE_YEARS[0]), first), offset_intervals(zone, *MODEL_YEARS)
        except Exception:  # noqa: BLE001  an unknown zone has no intervals, so its local times stay unread
            continue
        for year in range(first, last + 1):
            lo, hi = int((datetime(year, 1, 1) - epoch).total_seconds()), int((datetime(year + 1, 1, 1) - epoch).total_seconds())
            parts = [(int((a - epoch).total_seconds()) + o, int((b - epoch).total_seconds()) + o, o) for a, b, o in spans]
            # one interval more on either side, so that a gap or overlap at the turn of the year has both its sides
            near = [i for i, (a, b, _) in enumerate(parts) if a <= hi + 172800 and b > lo - 172800]
            rows.append((zone, year, [parts[i] for i in range(max(0, near[0] - 1), min(len(parts), near[-1] + 2))]))
        parts = [(int((a - epoch).total_seconds()) + o, int((b - epoch).total_seconds()) + o, o) for a, b, o in early]
        rows.append((zone, first - 1, [(-(1 << 60), *parts[0][1:]), *parts[1:]]))
        for year in range(MODEL_YEARS[0], MODEL_YEARS[1] + 1):
            lo = int((datetime(year, 1, 1) - epoch).total_seconds())
            parts = [(int((a - epoch).total_seconds()) + o - lo, int((b - epoch).total_seconds()) + o - lo, o) for a, b, o in late]
            near = [p for p in parts if p[0] <= 367 * 86400 and p[1] > -86400]
            calendar = _CALENDARS + 2 * datetime(year, 1, 1).weekday() + (year % 4 == 0)
            if (zone, calendar) not in done:
                done.add((zone, calendar))
                rows.append((zone, calendar, near))
    entry = T.StructType([T.StructField(n, T.LongType()) for n in ("local_from", "local_to", "offset")])
    return spark.createDataFrame(rows, T.StructType([T.StructField("zone", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("spans", T.ArrayType(entry))]))


def _canonical(text: Column) -> Column:
    for pattern, line in SHAPES:
        text = F.regexp_replace(text, pattern, line)
    return F.split(text, r"\|")


def held(d: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, computed once here: no later filter or projection is merged into them.

    The optimizer moves a filter below a projection by repeating the projected expressions in it, which
    would run the chain of patterns once per use; it doesn't move one below a generator.
    """
    return d.select(F.inline(F.array(F.struct(*columns))))


def _part(i: int) -> Column:
    return F.nullif(F.get("_f", F.lit(i)), F.lit(""))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def read_times(d: DataFrame, text: str, day_first: str, keep: list[str]) -> DataFrame:
    """The kept columns with _local (seconds of the wall clock), _micros, _year, _offset (if a zone is named) and _epoch.

    The steps are columns of their own, so that each is computed once and the generated code stays small.
    """
    months = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, v)])
    long_months = F.create_map(*[F.lit(x) for k, v in LONG_MONTHS.items() for x in (k, v)])
    offsets = F.create_map(*[F.lit(x) for k, v in ZONE_OFFSETS.items() for x in (k, v)])
    d = held(d, *keep, F.col(day_first).alias("_first"), _canonical(F.lower(stripped(F.regexp_replace(F.col(text), BLANKS, " ")))).alias("_f"))
    swap = (F.get("_f", F.lit(0)) == "slash") & F.coalesce(F.col("_first"), F.lit(False))
    zone = _part(9)
    d = held(
        d.where(F.size("_f") == 10), *keep, F.get("_f", F.lit(0)).alias("_kind"), _part(1).alias("_head"), F.when(swap, _part(3)).otherwise(_part(2)).alias("_month_text"),
        _int(F.when(swap, _part(2)).otherwise(_part(3))).alias("_day"), _int(_part(4)).alias("_hour"), _int(_part(5)).alias("_minute"), _int(_part(6)).alias("_second"),
        F.coalesce(_part(7), F.lit("")).alias("_fraction"), _part(8).alias("_half"), zone.alias("_zone"),
        F.regexp_replace(zone, r"^(?:gmt|utc)?([+-])(\d{2}):?(\d{2})?$", "$1|$2|$3").alias("_signed"),
    )
    d = d.withColumns({
        "_year": F.when(F.col("_kind") != "epoch", _int(F.col("_head"))),
        "_month": F.coalesce(_int(F.col("_month_text")), long_months[F.substring("_month_text", 1, 4)], months[F.substring("_month_text", 1, 3)]),
        "_hour24": F.when(F.col("_half").isNull(), F.col("_hour")).when(F.col("_hour").between(1, 12), F.col("_hour") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0)),
        "_offset": F.when(F.col("_signed").contains("|"), (
            _int(F.get(F.split("_signed", r"\|"), F.lit(1))) * 3600 + F.coalesce(_int(F.get(F.split("_signed", r"\|"), F.lit(2))), F.lit(0)) * 60
        ) * F.when(F.col("_signed").startswith("-"), -1).otherwise(1)).otherwise(offsets[F.col("_zone")]),
        "_micros": F.rpad(F.substring("_fraction", 1, 6), 6, "0").cast("long"),
        "_whole": F.when(F.col("_kind") == "epoch", F.col("_head").try_cast("long")),
    })
    fits = F.col("_hour").isNull() | (F.col("_hour24").between(0, 23) & (F.coalesce("_minute", F.lit(0)) < 60) & (F.coalesce("_second", F.lit(0)) < 60))
    zone_ok = F.col("_zone").isNull() | (F.abs("_offset") <= 50400)
    d = d.withColumn("_date", F.when(fits & zone_ok, F.try_to_date(F.format_string("%04d-%02d-%02d", "_year", "_month", "_day"), "yyyy-MM-dd")))
    seconds = F.unix_date("_date").cast("long") * 86400 + F.coalesce("_hour24", F.lit(0)) * 3600 + F.coalesce("_minute", F.lit(0)) * 60 + F.coalesce("_second", F.lit(0))
    # epoch: seconds below 1e11, else milliseconds; digits beyond microseconds are cut off
    epoch = F.when(F.col("_whole") < 100_000_000_000, F.col("_whole") * 1_000_000 + F.col("_micros")).otherwise(
        F.col("_whole") * 1000 + F.rpad(F.substring("_fraction", 1, 3), 3, "0").cast("long"))
    return held(d, *keep, seconds.alias("_local"), "_micros", "_year", "_offset", epoch.alias("_epoch")).where("_local IS NOT NULL OR _epoch IS NOT NULL")


def utc_instants(
    df: DataFrame,
    fields: Mapping[str, Column | str | None],
    *,
    key: str = "id",
    day_first: Column | None = None,
    default_zone: str = "UTC",
    zones: Sequence[str] | None = None,
    max_zones: int = 700,
    years: tuple[int, int] = (1970, 2069),
) -> DataFrame:
    """Rows (key, field_name, utc_micros, reading), distinct: one for each value that names a possible absolute date.

    ``fields`` maps a text column to the column of its zone, a zone's name, or null for ``default_zone``.
    ``reading`` says how the offset was found: stated, epoch, one, ambiguous (the earlier instant is
    given) or skipped (moved on by the length of the gap). Slashed dates follow ``day_first`` (null or
    not given: the month leads) unless the year leads; ``zones`` names the zones that occur, else they are
    looked up; dotted dates lead with the day; a date alone is
    local midnight. Nulls, empty and wordy texts, relative phrases, impossible dates or times, unknown
    zones give no row. Repeated rows give one. The zone table has one row per zone and year of ``years``
    and on to 2099, one for all years before and 14 for those after: ``max_zones`` and ``years`` bound
    what is broadcast.
    """
    spark = df.sparkSession
    first = day_first if day_first is not None else F.lit(False)
    entries = [
        F.struct(F.lit(n).alias("field_name"), F.col(n).alias("text"), F.coalesce(z if isinstance(z, Column) else F.lit(z or default_zone), F.lit(default_zone)).alias("zone"))
        for n, z in fields.items()
    ]
    d = df.select(F.col(key), first.alias("_first"), F.explode(F.array(*entries)).alias("_e")).select(key, "_first", "_e.*").where("text IS NOT NULL")
    d = d.where(F.col("text").rlike(r"\d{4}|^\s*\d"))
    d = read_times(d, "text", "_first", [key, "field_name", "zone"])
    names = sorted({z or default_zone for z in fields.values() if not isinstance(z, Column)} | {default_zone, *(zones or ())})
    for z in fields.values():
        if isinstance(z, Column) and zones is None:
            names = sorted({*names, *(r[0] for r in df.select(z.alias("z")).where("z IS NOT NULL").distinct().limit(max_zones + 1).collect())})
    if len(names) > max_zones:
        raise ValueError("more zones than max_zones")
    spans = zone_years(spark, names, *years)
    new_year = F.unix_date(F.make_date("_year", F.lit(1), F.lit(1)))
    leap = F.dayofyear(F.make_date("_year", F.lit(12), F.lit(31))) - 365
    late = F.col("_year") > max(years[1], RULE_YEARS[1])
    d = d.withColumns({
        "_clock": F.when(late, F.col("_local") - new_year.cast("long") * 86400).otherwise(F.col("_local")),
        "_row": F.when(late, F.lit(_CALENDARS) + 2 * F.weekday(F.make_date("_year", F.lit(1), F.lit(1))) + leap).otherwise(F.greatest("_year", F.lit(years[0] - 1))),
    })
    d = d.join(F.broadcast(spans.withColumnsRenamed({"zone": "_z", "year": "_y"})), (F.col("zone") == F.col("_z")) & (F.col("_row") == F.col("_y")), "left")
    hit = F.filter("spans", lambda x: (F.col("_clock") >= x["local_from"]) & (F.col("_clock") < x["local_to"]))
    before = F.array_max(F.filter("spans", lambda x: x["local_to"] <= F.col("_clock")))  # of the interval that ended last
    d = d.withColumn("_hit", hit).withColumn("_before", before)
    offset = F.coalesce(F.col("_offset").cast("long"), F.array_max(F.transform("_hit", lambda x: x["offset"])), F.col("_before.offset"))
    reading = (
        F.when(F.col("_epoch").isNotNull(), "epoch").when(F.col("_offset").isNotNull(), "stated").when(F.size("_hit") > 1, "ambiguous")
        .when(F.size("_hit") == 1, "one").when(F.col("_before").isNotNull(), "skipped")
    )
    instant = F.coalesce(F.col("_epoch"), (F.col("_local") - offset) * 1_000_000 + F.col("_micros"))
    return d.select(key, "field_name", instant.alias("utc_micros"), reading.alias("reading")).where("utc_micros IS NOT NULL").distinct()
