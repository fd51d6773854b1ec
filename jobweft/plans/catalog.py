"""All registered queries and their SQL, by name."""

from jobweft.plans import cases, listing, problems, relational
from jobweft.streaming import pipelines

QUERIES = {**relational.QUERIES, **listing.QUERIES, **cases.QUERIES, **pipelines.QUERIES, **problems.QUERIES}
SQL = {**relational.SQL, **listing.SQL, **cases.SQL, **pipelines.SQL, **problems.SQL}
