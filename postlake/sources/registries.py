"""Registries, city lists, crawl indexes, robots rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.keys import host, labelled_numbers
from postlake.functions.scalars import html_text
from postlake.matching.positions import normal
from postlake.operators.queues import after

RECORD = """id string, identifiers array<struct<value:string,validTo:string>>, fullNames array<struct<value:string,validTo:string>>,
legalForms array<struct<value:struct<code:string>,validTo:string>>, statisticalCodes struct<mainActivity:struct<code:string>>, termination string"""
#: Legal forms of natural persons; activity codes of employment agencies begin so.
PERSONS = tuple(str(n) for n in range(100, 111))
AGENCY = "78"
GEO = "geonameid string, name string, asciiname string, alternatenames string, latitude string, longitude string, class string, code string, country string, cc2 string, a1 string, a2 string, a3 string, a4 string, population long, elevation string, dem string, timezone string, modified string"


def current(values: Column) -> Column:
    """The value without an end, else the last one."""
    open_ = F.filter(values, lambda v: v["validTo"].isNull())
    return F.coalesce(F.try_element_at(open_, F.lit(-1)), F.try_element_at(values, F.lit(-1)))["value"]


def companies(records: DataFrame, country: str = "SK") -> DataFrame:
    """(country, registration_number, name, agency, terminated_on) of records, without natural persons."""
    form = current(F.col("legalForms"))["code"]
    out = records.where(form.isNull() | ~form.isin(*PERSONS)).select(
        F.lit(country).alias("country"),
        F.lpad(current(F.col("identifiers")), 8, "0").alias("registration_number"),
        current(F.col("fullNames")).alias("name"),
        F.coalesce(F.startswith("statisticalCodes.mainActivity.code", F.lit(AGENCY)), F.lit(False)).alias("agency"),
        F.try_to_date("termination", "yyyy-MM-dd").alias("terminated_on"),
    )
    return out.where("registration_number IS NOT NULL AND name IS NOT NULL")


def cities(geo: DataFrame, home: tuple[str, ...] = ("SK",), least_population: int = 500_000, least_length: int = 4) -> DataFrame:
    """(name, country): of each normalised name the country of its most populous city. Alternate
    names count for home countries, and elsewhere for large cities if they are long enough."""
    own = F.array("name", "asciiname")
    other = F.filter(F.split(F.coalesce("alternatenames", F.lit("")), ","), lambda x: F.col("country").isin(*home) | (F.length(x) >= least_length))
    names = F.when(F.col("country").isin(*home) | (F.col("population") >= least_population), F.concat(own, other)).otherwise(own)
    rows = geo.select(F.explode(F.array_distinct(F.transform(names, lambda x: F.trim(normal(x))))).alias("name"), "country", "population").where("name <> ''")
    return rows.groupBy("name").agg(F.max(F.struct("population", "country")).alias("m")).select("name", F.col("m.country").alias("country"))


def index_blocks(index: DataFrame, prefix: str) -> DataFrame:
    """Blocks of sorted crawl index files (file, surt, offset, length) that may hold a SURT prefix:
    those whose first key has it, and of each file the one before."""
    own = index.withColumn("next", F.lead("surt").over(Window.partitionBy("file").orderBy("surt")))
    return own.where(F.startswith("surt", F.lit(prefix)) | ((F.col("surt") < prefix) & (F.col("next").isNull() | (F.col("next") >= prefix)))).drop("next")


def numbers_on_pages(pages: DataFrame, most: int = 3) -> DataFrame:
    """(host, number) from pages (url, body): pages that name more than so many numbers don't count;
    of a host's pages a contact page is preferred, then the shortest address."""
    p = pages.select(host(F.col("url")).alias("host"), "url", labelled_numbers(html_text(F.col("body"))).alias("numbers")).where((F.size("numbers") > 0) & (F.size("numbers") <= most))
    best = p.groupBy("host").agg(F.min_by("numbers", F.struct(~F.col("url").rlike("(?i)kontakt|contact|impressum"), F.length("url"), "url")).alias("numbers"))
    return best.select("host", F.explode("numbers").alias("number"))


def allowed(rules: str | None, path: str, agent: str = "*") -> bool:
    """Whether robots rules let a path be read: of the matching rules of the agent's group (else of
    '*') the longest decides, allow before disallow; * stands for anything, $ for the end."""
    groups: dict[str, list[tuple[str, str]]] = {}
    names: list[str] = []
    fresh = True
    for line in (rules or "").splitlines():
        key, _, value = (x.strip() for x in line.split("#")[0].partition(":"))
        key = key.lower()
        if key == "user-agent":
            names = [value.lower()] if fresh else [*names, value.lower()]
            fresh = False
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            fresh = True
            for n in names:
                groups[n].append((key, value))
    own = groups.get(agent.lower(), groups.get("*", []))
    best = (0, True)
    for key, value in own:
        pattern = re.escape(value).replace(r"\*", ".*")
        pattern = pattern[:-2] + "$" if pattern.endswith(r"\$") else pattern
        if value and re.match(pattern, path):
            best = max(best, (len(value), key == "allow"))
    return best[1]


def robots(pages: DataFrame) -> DataFrame:
    """pages (rules, path) with allowed, by a vectorised function."""

    @F.pandas_udf("boolean")
    def decide(rules: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([allowed(r, p or "/") for r, p in zip(rules, path, strict=True)])

    return pages.withColumn("allowed", decide("rules", "path"))


def resume(records: DataFrame, cursor: dict | None, most: int) -> tuple[DataFrame, dict | None]:
    """(records of the next batch, the cursor behind them) of exports read file by file.

    records has export (its date; full ones come before the daily ones by their date), file and place, by
    which they are ordered; the cursor names the last one taken, None at the begin. A batch has at most so
    many records; the cursor stays where it is if nothing is left. A batch that is taken again from
    its cursor is the same, so an import may stop anywhere.
    """
    order = ("export", "file", "place")
    rest = records if cursor is None else after(records, cursor)
    batch = rest.orderBy(*order).limit(most)
    last = batch.agg(F.max(F.struct(*order)).alias("last")).collect()[0]["last"]  # one row
    return batch, last.asDict() if last else cursor
