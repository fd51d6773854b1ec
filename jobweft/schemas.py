"""Schemas of the tables, and the closed sets of values."""

from pyspark.sql import types as T

#: Fields that every source's snapshot row has, all text as sources send them.
SNAPSHOT_FIELDS = [
    "external_id", "title", "department", "location", "workplace_type", "employment_type", "salary_min", "salary_max", "salary_currency", "salary_interval", "description", "url", "posted_at", "raw_data",
]
SNAPSHOT = T.StructType([T.StructField(n, T.StringType()) for n in SNAPSHOT_FIELDS])
EMPLOYMENT_TYPES = ("Full-time", "Part-time", "Contract", "Internship", "Temporary", "Volunteer")
WORKPLACE_TYPES = ("Remote", "Hybrid", "Onsite")
EXPERIENCE_LEVELS = ("internship", "entry", "mid", "senior", "lead", "executive")
# Boards that can be read, and other labels of some of them.
SUPPORTED_BOARDS = (
    "greenhouse ashby lever workable recruitee smartrecruiters rippling personio breezy jazzhr workday zoho icims oracle bamboohr taleo pinpoint successfactors comeet paylocity "
    "teamtailor jobvite amazon netflix google oraclecloud"
).split()
BOARD_ALIASES = {
    "grnhse": "greenhouse", "myworkdayjobs": "workday", "icims2": "icims", "zohorecruit": "zoho", "jworkable": "workable", "taleo_careersection": "taleo", "taleo_selectminds": "taleo",
}
