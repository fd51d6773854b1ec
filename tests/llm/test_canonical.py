import pytest

from jobweft.llm.canonical import map_to_canonical

CANON = [(1, "employment_type", "Full-time"), (2, "employment_type", "Part-time"), (3, "employment_type", "Contract"), (4, "employment_type", "Internship"), (5, "employment_type", "Temporary"), (6, "employment_type", "Volunteer"),
         (11, "workplace_type", "Remote"), (12, "workplace_type", "Hybrid"), (13, "workplace_type", "Onsite"),
         (100, "location", "Drumebrooke, Midessa, NL"), (101, "location", "Drumebrooke, Eldveria, GB"), (102, "location", "Saint Oskottlund, Ostessa, IN"), (103, "location", "Port Altenemünde, Ostmark, GB"), (104, "location", "Drumenried, Noronia, US")]
SCHEMA = "id bigint, employment_type string, workplace_type string, location string, canon_id bigint, field_name string, value string"
CASES = {
    "employment_type": {"FULL_TIME": 1, "Fulll-time": 1, "Full-teme": 1, "Fullttime": 1, " FT ": 1, "Permanent / Part Time": 2, "Teilzeit (50%)": 2, "Conrtact": 3, "B2B": 3, "Internship, full time": 4, "seasonal (full time)": 5,
                        "per diem": 5, "Volunteering": 6, "temps plein": 1, "Grade 7": 0, "see description": 0, "Full-time ": 1},
    "workplace_type": {"hybrid remote": 12, "híbrido": 12, "télétravail": 11, "Home Office": 11, "vor Ort": 13, "ON SITE": 13, "Osnite": 13, "not remote": 13, "50% travel": 0, "ZONE 3": 0},
    "location": {"Drumebrooke (NL)": 100, "12345 Drumebrooke, United Kingdom": 101, "drumebrooke eldveria gb": 101, "St. Oskottlund": 102, "Saint Oskotlund, India": 102, "Oskottlund": 0, "Pt Altenemuende": 103, "Remote - Port Altenemünde, GB": 103,
                 "Saint Drumenried": 0, "Greater Drumenried Area, United States": 104, "Remote, US": 0, "Noronia": 0, "United States": 0, "Drumebrooke": 100, "x " * 3000 + "Drumenried": 104},
}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def results(spark):
    rows, keys = [], {}
    for f, (field, cases) in enumerate(CASES.items()):
        for i, value in enumerate(cases):
            key = f * 1000 + i
            keys[field, value] = key
            rows += [(key, *[value if field == c else None for c in CASES])] * 2  # repeated
    rows += [(9000, "Full-time", "Remote", "Drumenried, Noronia, US"), (9001, "", " ", None), (None, "FT", None, None)]
    canon = spark.createDataFrame(CANON, "canon_id bigint, field_name string, entry string")
    got = {(r["id"], r["field_name"]): r["canon_id"] for r in map_to_canonical(frame(spark, rows), canon).collect()}
    assert not any(k[0] in (9000, 9001, None) for k in got)
    return {(f, v): got[k, f] for (f, v), k in keys.items()}


@pytest.mark.parametrize(("field", "value"), [(f, v) for f, c in CASES.items() for v in c])
def test_case(results, field, value):
    assert results[field, value] == CASES[field][value]


def test_empty(spark):
    canon = spark.createDataFrame(CANON, "canon_id bigint, field_name string, entry string")
    assert map_to_canonical(frame(spark, []), canon).count() == 0
    assert [r["canon_id"] for r in map_to_canonical(frame(spark, [(1, "FT", None, None)]), canon.limit(0)).collect()] == [0]
