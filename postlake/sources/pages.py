"""Further captured pages: tile lists, portal offers, employer pages, registry answers, HTTP outcomes."""

from __future__ import annotations

import gzip
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import keys, scalars
from postlake.matching.brands import on_portal
from postlake.sources.parsers import _none, _posting, anchors

# Least number of employees for the size codes of the register of statements.
SIZES = {"00": None, "01": 0, "02": 1, "03": 2, "04": 3, "05": 5, "06": 10, "07": 20, "08": 25, "09": 50, "10": 100, "11": 150, "12": 200, "13": 250, "14": 500, "15": 1000, "16": 2000, "17": 3000, "18": 4000, "19": 5000, "20": 10000, "21": 20000, "22": 30000}


def successfactors(bodies: DataFrame, country: str | None = None, name: str | None = None) -> DataFrame:
    """Rows of a results table or tiles: link with jobTitle-link, place in jobLocation or a tile's
    location. Of a country if the last two-letter code of the place list is it, else if the place
    names it; rows without a place stay."""
    rows = F.regexp_extract_all("body", F.lit(r'(?s)<(?:tr|li)[^>]*class="[^"]*(?:data-row|job-tile)[^"]*"[^>]*>(.*?)</(?:tr|li)>'), F.lit(1))
    r = bodies.select("board", F.explode(rows).alias("j"))
    place = F.nullif(scalars.html_text(F.regexp_extract("j", r'(?s)class="[^"]*(?:jobLocation|location)[^"]*"[^>]*>(.*?)</', 1)), F.lit(""))
    path = F.regexp_extract("j", r'href="([^"?#]+)[^"]*"[^>]*class="[^"]*jobTitle-link', 1)
    path = F.when(path == "", F.regexp_extract("j", r'class="[^"]*jobTitle-link[^"]*"[^>]*href="([^"?#]+)', 1)).otherwise(path)
    title = scalars.html_text(F.regexp_extract("j", r'(?s)class="[^"]*jobTitle-link[^"]*"[^>]*>(.*?)</a', 1))
    out = _posting(r, path, title, F.concat(F.lit("https://"), "board", path), place, _none("date"), _none())
    if country:
        code = F.try_element_at(F.regexp_extract_all("location", F.lit(r"(?:^|,\s*)([A-Z]{2})(?=\s*(?:,|$))"), F.lit(1)), F.lit(-1))
        named = F.contains(keys.fold(F.col("location")), F.lit((name or country).lower()))
        out = out.where(F.col("location").isNull() | F.coalesce(code == country, named))
    return out


def portal_offer(pages: DataFrame) -> DataFrame:
    """(external_id, posted, isco, employer_url) of the state portal's offer pages (external_id, body):
    the creation date, the first 4 of 7 occupation digits, the first outside link under the button."""
    value = lambda label: scalars.html_text(F.regexp_extract("body", rf"(?s)<dt[^>]*>\s*{label}[^<]*</dt>\s*<dd[^>]*>(.*?)</dd>", 1))
    link = F.nullif(F.regexp_extract("body", r'(?s)<a[^>]*class="[^"]*employer-link[^"]*"[^>]*href="(https?://[^"]+)"', 1), F.lit(""))
    return pages.select("external_id", scalars.portal_date(value("Dátum vytvorenia")).alias("posted"), F.nullif(F.regexp_extract(value("Zamestnanie"), r"\b(\d{4})\d{3}\b", 1), F.lit("")).alias("isco"), link.alias("employer_url"))


def company_page_link(pages: DataFrame) -> DataFrame:
    """(slug, url): of a portal's company pages (slug, body) the best outside link: one that names a
    career page, else the first that is no portal."""

    @F.pandas_udf("array<struct<url:string,text:string>>")
    def links(bodies: pd.Series) -> pd.Series:
        return pd.Series([[{"url": u, "text": t} for u, t in anchors(b) if u.startswith("http")] for b in bodies])

    r = pages.select("slug", F.posexplode(links("body")).alias("at", "l")).where(~on_portal(keys.host(F.col("l.url"))))
    rank = F.when(F.concat_ws(" ", "l.text", "l.url").rlike("(?i)kari[eé]r|career|jobs?"), 0).otherwise(1)
    return r.groupBy("slug").agg(F.min_by("l.url", F.struct(rank, "at")).alias("url"))


def least_employees(code: Column) -> Column:
    """Least number of employees of a size code; null for unknown ones."""
    known = {k: v for k, v in SIZES.items() if v is not None}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), code)


def wikidata_sites(bodies: DataFrame) -> DataFrame:
    """(registration_number, url) of captured SPARQL answers."""
    schema = "results struct<bindings:array<struct<number:struct<value:string>,site:struct<value:string>>>>"
    r = bodies.select(F.explode(F.from_json("body", schema)["results"]["bindings"]).alias("b"))
    number = F.lpad(F.regexp_replace("b.number.value", r"\D", ""), 8, "0")
    return r.select(number.alias("registration_number"), F.col("b.site.value").alias("url")).where(keys.is_web_url(F.col("url")) & (number != "00000000")).distinct()


def warc_pages(files: DataFrame) -> DataFrame:
    """(url, body) of WARC records in binary files (path, content), plain or gzipped member by member.
    One file is read in one task, as its members can't be found otherwise."""

    def run(batches):
        for b in batches:
            rows = []
            for raw in b.column("content").to_pylist():
                text = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                for record in re.split(rb"(?m)^WARC/1\.[01]\r\n", text)[1:]:
                    head, _, rest = record.partition(b"\r\n\r\n")
                    url = re.search(rb"(?im)^WARC-Target-URI:\s*<?([^\s>]+)", head)
                    if not url or not re.search(rb"(?im)^WARC-Type:\s*response", head):
                        continue
                    http, _, body = rest.partition(b"\r\n\r\n")
                    charset = re.search(rb"(?i)charset=[\"']?([\w-]+)", http)
                    try:
                        rows.append((url[1].decode(), body.decode((charset[1] if charset else b"utf-8").decode(), "replace").strip()))
                    except LookupError:
                        rows.append((url[1].decode(), body.decode("utf-8", "replace").strip()))
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], names=["url", "body"])

    return files.select("content").mapInArrow(run, "url string, body string")


def employer_list(bodies: DataFrame) -> DataFrame:
    """(number, name, url) of a portal's employer list pages."""
    rows = F.regexp_extract_all("body", F.lit(r'(?s)(<a[^>]*href="[^"]*/zamestnavatel/\d+[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    r = bodies.select(F.explode(rows).alias("j"))
    url = F.regexp_extract("j", r'href="([^"]+)"', 1)
    return r.select(F.regexp_extract(url, r"/zamestnavatel/(\d+)", 1).alias("number"), scalars.html_text(F.col("j")).alias("name"), url.alias("url")).where("name <> ''").dropDuplicates(["number"])


def http_outcome(status: Column, error: Column) -> Column:
    """struct(kind, temporary) of a captured response: null for success."""
    kind = (
        F.when(error == "ROBOTS", "USE_FORBIDDEN")
        .when(error == "TOO_LARGE", "TOO_LARGE")
        .when(error.isNotNull(), "NETWORK")
        .when(status.isin(401, 403), "ACCESS_DENIED")
        .when(status.isin(404, 410), "NOT_FOUND")
        .when(status == 429, "RATE_LIMITED")
        .when(status >= 500, "SERVER_ERROR")
        .when((status < 200) | (status >= 300), "UNEXPECTED_STATUS")
    )
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), kind.isin("NETWORK", "RATE_LIMITED", "SERVER_ERROR").alias("temporary")))


BENCHMARK = "rank int, name string, registration_number string, country string, employees int"


def benchmark_list(spark, path: str) -> DataFrame:
    """A benchmark list as CSV with a header, quotes inside quoted values doubled; of a line that doesn't parse, broken has the whole text."""
    own = spark.read.schema(f"{BENCHMARK}, broken string").option("header", "true").option("escape", '"').option("mode", "PERMISSIVE")
    return own.option("columnNameOfCorruptRecord", "broken").csv(path)
