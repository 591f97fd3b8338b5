"""Schemas of the domain tables, and checks of what a database would enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns and types by table.
DDL = {
    "source": "id long, provider string, board string, country string, availability string, created_at timestamp_ntz, closed_at timestamp_ntz, employer_name string",
    "vacancy": "id long, state string, title string, primary_url string, first_seen_at timestamp_ntz, last_confirmed_at timestamp_ntz, closed_at timestamp_ntz, posted_at timestamp_ntz, match_version string, work_countries array<string>, work_format string",
    "job_posting": "id long, vacancy_id long, source_id long, external_id string, title string, url string, location string, content string, confirmed boolean, missing int, closed_at timestamp_ntz, occupation_code string, title_occupation_code string, employer_url string",
    "crawl_run": "id long, source_id long, started_at timestamp_ntz, finished_at timestamp_ntz, state string, reason string, postings int",
    "company": "id long, country string, registration_number string, name string, agency boolean, not_employer boolean, no_own_career_page boolean, first_seen_at timestamp_ntz, terminated_on date, loss_postponed_until timestamp_ntz",
    "company_source": "company_id long, source_id long, role string",
    "company_site": "id long, company_id long, host string, source string, proof string, status string, check_result string, found_at timestamp_ntz, checked_at timestamp_ntz",
    "company_check": "company_id long, result string, first_checked_at timestamp_ntz, checked_at timestamp_ntz",
    "position": "id long, code string, name string, occupation_code string",
    "vacancy_position_match": "vacancy_id long, position_id long, explanation string",
    "condition": "id long, user_id long, countries array<string>, work_format string, active boolean",
    "condition_position": "condition_id long, position_id long",
    "condition_occupation": "condition_id long, code string",
    "user_status": "user_id long, vacancy_id long, status string, changed_at timestamp_ntz",
    "delivered": "condition_id long, vacancy_id long, delivered_at timestamp_ntz",
    "task": "id long, type string, key string, state string, updated_at timestamp_ntz, attempts int",
}
#: Unique keys, allowed values.
KEYS = {"source": ["provider", "board"], "job_posting": ["source_id", "external_id"], "company": ["country", "registration_number"], "company_source": ["company_id", "source_id"], "user_status": ["user_id", "vacancy_id"], "delivered": ["condition_id", "vacancy_id"]}
ALLOWED = {
    ("vacancy", "state"): ("ACTIVE", "NEEDS_RECHECK", "CLOSED"),
    ("vacancy", "work_format"): ("OFFICE", "HYBRID", "REMOTE", "CONFLICT"),
    ("source", "availability"): ("OK", "TEMP_FAILING", "UNAVAILABLE"),
    ("crawl_run", "state"): ("RUNNING", "COMPLETE", "PARTIAL", "FAILED"),
    ("company_source", "role"): ("EMPLOYER", "AGENCY", "GROUP"),
    ("company_site", "status"): ("FOUND", "CANDIDATE", "REJECTED"),
    ("user_status", "status"): ("VIEWED", "NOT_INTERESTED", "APPLIED", "INTERVIEW", "REJECTED"),
}


def schema(table: str) -> T.StructType:
    """The StructType of a table."""
    return T._parse_datatype_string(DDL[table])


def violations(table: str, df: DataFrame) -> DataFrame:
    """(rule, n) of the broken rules of a table: missing columns don't count, null keys and values do."""
    found = []
    keys = [k for k in KEYS.get(table, ()) if k in df.columns]
    if keys and len(keys) == len(KEYS.get(table, ())):
        twice = df.groupBy(*keys).count().where("count > 1")
        found.append(twice.agg(F.lit("unique " + ", ".join(keys)).alias("rule"), F.count("*").alias("n")))
        null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        found.append(df.agg(F.lit("not null " + ", ".join(keys)).alias("rule"), F.count_if(null).alias("n")))
    for (name, column), values in ALLOWED.items():
        if name == table and column in df.columns:
            found.append(df.agg(F.lit(f"{column} allowed").alias("rule"), F.count_if(~F.col(column).isin(*values)).alias("n")))
    if table == "crawl_run" and {"state", "reason"} <= set(df.columns):
        found.append(df.agg(F.lit("reason if and only if not complete").alias("rule"), F.count_if((F.col("state").isin("PARTIAL", "FAILED")) != F.col("reason").isNotNull()).alias("n")))
    if not found:
        return df.sparkSession.createDataFrame([], "rule string, n long")
    return reduce(lambda a, b: a.unionByName(b), found).where("n > 0")
