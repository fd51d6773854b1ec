from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from jobweft.operators.timestamps import utc_instants

SCHEMA = "id bigint, t string, z string, d boolean, field_name string"


def micros(*a, **k):
    return int((datetime(*a, **k) - datetime(1970, 1, 1)) / timedelta(microseconds=1))


NY, BERLIN = "America/New_York", "Europe/Berlin"
CASES = [
    ("2024-05-24T18:34:22.563811308Z", NY, micros(2024, 5, 24, 18, 34, 22, 563811)), ("2024-07-29T06:53:18-07:00", BERLIN, micros(2024, 7, 29, 13, 53, 18)),
    ("2024-07-03 23:52:29.880409-0400", BERLIN, micros(2024, 7, 4, 3, 52, 29, 880409)), ("2024-01-17 10:25:16+00", NY, micros(2024, 1, 17, 10, 25, 16)),
    ("2024-06-30 23:53:09 CEST", NY, micros(2024, 6, 30, 21, 53, 9)), ("2024-05-08 03:18:41 PDT", BERLIN, micros(2024, 5, 8, 10, 18, 41)),
    ("Sun, 02 Mar 2025 16:29:01 GMT", NY, micros(2025, 3, 2, 16, 29, 1)), ("Mon, 21 Oct 2024 10:32:09 -0330", NY, micros(2024, 10, 21, 14, 2, 9)),
    ("Sat Jun 29 2024 12:03:47 GMT+0530 (India Standard Time)", NY, micros(2024, 6, 29, 6, 33, 47)), ("20240922220151", "UTC", micros(2024, 9, 22, 22, 1, 51)),
    ("20240919T064654", "UTC", micros(2024, 9, 19, 6, 46, 54)), ("1699432755", NY, 1699432755_000000), ("1706858586472", NY, 1706858586472_000), ("1741772195.03", NY, 1741772195_030000),
    ("20240919", NY, 20240919_000000), ("1706858586472.1239", NY, 1706858586472_123), ("5/6/2024 2:01 PM", NY, micros(2024, 5, 6, 18, 1)), ("13/6/2024 14:01", BERLIN, micros(2024, 6, 13, 12, 1)),
    ("2024/01/31", BERLIN, micros(2024, 1, 30, 23)), (" 2024-03-17 ", "UTC", micros(2024, 3, 17)), ("24.07.2024 20:14:06", BERLIN, micros(2024, 7, 24, 18, 14, 6)),
    ("March 13, 2025 1:42 AM", "UTC", micros(2025, 3, 13, 1, 42)), ("3-Mar-2025 18:37", "UTC", micros(2025, 3, 3, 18, 37)), ("25 March 2025", NY, micros(2025, 3, 25, 4)),
    ("12/31/2024 12:05 AM", "UTC", micros(2024, 12, 31, 0, 5)), ("2024-11-03 01:30:00", NY, micros(2024, 11, 3, 5, 30)), ("2024-03-10 02:30:00", NY, micros(2024, 3, 10, 7, 30)),
    ("2024-10-27 02:30", BERLIN, micros(2024, 10, 27, 0, 30)), ("2024-03-31T02:15:00.5", BERLIN, micros(2024, 3, 31, 1, 15, 0, 500000)), ("2024-02-29", "UTC", micros(2024, 2, 29)),
    ("2024-02-30T10:00:00Z", "UTC", None), ("2024-13-01", "UTC", None), ("31/31/2024", "UTC", None), ("0000-00-00 00:00:00", "UTC", None), ("Posted 3 days ago", "UTC", None), ("yesterday", "UTC", None),
    ("30+ days ago", "UTC", None), ("N/A", "UTC", None), ("", "UTC", None), (None, "UTC", None), ("2024-01-01 25:00", "UTC", None), ("2024-01-01 10:00 XYZ", "UTC", None), ("1|2|3", "UTC", None),
    ("2024-01-01 " * 20_000, "UTC", None), ("2024-05-01 10:00:00", "No/Where", None), ("2024-05-01 10:00:00", None, micros(2024, 5, 1, 10)),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(i, t, z, t is not None and t.startswith("13/"), "clash") for i, (t, z, _) in enumerate(CASES) for _ in range(2)]
    got = utc_instants(spark.createDataFrame(rows, SCHEMA), {"t": F.col("z")}, day_first=F.col("d")).collect()
    assert len(got) == len({r["id"] for r in got})
    return {r["id"]: (r["utc_micros"], r["reading"]) for r in got}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(results, i):
    assert results.get(i, (None,))[0] == CASES[i][2], CASES[i][0]


def test_readings(results):
    at = {t: results[i][1] for i, (t, _, _) in enumerate(CASES) if i in results}
    assert at["2024-11-03 01:30:00"] == "ambiguous" and at["2024-03-10 02:30:00"] == "skipped" and at["1699432755"] == "epoch" and at["25 March 2025"] == "one"


def test_every_hour_like_the_library(spark):
    """All half hours of two years in three zones, read once as local time, against zoneinfo."""
    zones = [NY, "Australia/Sydney", "Asia/Kolkata"]
    start = datetime(2024, 1, 1)
    times = [start + timedelta(minutes=30 * k) for k in range(2 * 365 * 48)]
    rows = [(z_i * 10**6 + k, t.strftime("%Y-%m-%d %H:%M:%S"), z, False, "") for z_i, z in enumerate(zones) for k, t in enumerate(times)]
    got = {r["id"]: r["utc_micros"] for r in utc_instants(spark.createDataFrame(rows, SCHEMA), {"t": F.col("z")}, zones=zones).collect()}
    for z_i, z in enumerate(zones):
        for k, t in enumerate(times):
            want = t.replace(tzinfo=ZoneInfo(z), fold=0).astimezone(UTC).replace(tzinfo=None)
            assert got[z_i * 10**6 + k] == micros(*want.timetuple()[:6])


def test_empty(spark):
    assert utc_instants(spark.createDataFrame([], SCHEMA), {"t": "UTC"}).count() == 0
    with pytest.raises(ValueError):
        utc_instants(spark.createDataFrame([(1, "2024", "a", None, "")], SCHEMA), {"t": "UTC"}, zones=["a", "b"], max_zones=1)


def test_french_months_and_years_outside_the_table(spark):
    far = [(datetime(y, m, 15, 12), z) for y in (1900, 1944, 1965, 1969, 2070, 2080, 2099, 2100, 2222, 2400, 9998) for m in (1, 7) for z in (NY, BERLIN, "Australia/Sydney", "Africa/Casablanca")]
    cases = [(t.strftime("%Y-%m-%d %H:%M:%S"), z, micros(*t.replace(tzinfo=ZoneInfo(z)).astimezone(UTC).replace(tzinfo=None).timetuple()[:6])) for t, z in far] + [
        ("12 juin 2024", "UTC", micros(2024, 6, 12)), ("3 juillet 2024 14:00", BERLIN, micros(2024, 7, 3, 12)), ("3 juil. 2024", "UTC", micros(2024, 7, 3)),
        ("1969-12-31", "UTC", micros(1969, 12, 31)), ("1900-01-01", "UTC", micros(1900, 1, 1)), ("9999-12-31", "UTC", micros(9999, 12, 31)), ("1969-12-31", "No/Where", None)]
    got = {r["id"]: r["utc_micros"] for r in utc_instants(spark.createDataFrame([(i, t, z, False, "") for i, (t, z, _) in enumerate(cases)], SCHEMA), {"t": F.col("z")}).collect()}
    for i, (text, zone, want) in enumerate(cases):
        assert got.get(i) == want, (text, zone)
