"""Feeds of hiring systems, from captured payloads (board, page, body) to one posting schema.

Every parser returns board, external_id, title, url, location, posted (date), content. JSON is
read by from_json with a fixed schema, so a malformed body gives no rows, never an error; XML and
HTML bodies by native expressions where a pattern will do, else by one vectorised function.
"""

from __future__ import annotations

import json
import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import keys, scalars

POSTING = "board string, external_id string, title string, url string, location string, posted date, content string"
_none = lambda kind="string": F.lit(None).cast(kind)


def _rows(bodies: DataFrame, schema: str, path: str = "") -> DataFrame:
    """One row j per element of an array in the body (the body itself, or the field at path)."""
    parsed = F.from_json("body", schema, {"mode": "PERMISSIVE"})
    return bodies.select("board", F.explode(parsed if not path else parsed[path]).alias("j")).where("j IS NOT NULL")


def _posting(rows: DataFrame, external_id: Column, title: Column, url: Column, location: Column, posted: Column, content: Column) -> DataFrame:
    out = rows.select("board", external_id.cast("string").alias("external_id"), F.trim(title).alias("title"), url.alias("url"), location.alias("location"), posted.cast("date").alias("posted"), content.alias("content"))
    return out.where("external_id IS NOT NULL AND external_id <> '' AND title IS NOT NULL AND title <> ''")


def greenhouse(bodies: DataFrame) -> DataFrame:
    """Board JSON: jobs[] with id, title, location.name, first_published, content."""
    r = _rows(bodies, "jobs array<struct<id:bigint,title:string,absolute_url:string,location:struct<name:string>,first_published:string,content:string>>", "jobs")
    return _posting(r, F.col("j.id"), F.col("j.title"), F.col("j.absolute_url"), F.col("j.location.name"), scalars.iso_date(F.col("j.first_published")), F.col("j.content"))


def personio(bodies: DataFrame) -> DataFrame:
    """XML feed: position elements; the texts of its descriptions joined by line feeds."""
    tag = lambda x, name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(x, rf"(?s)<{name}>(.*?)</{name}>", 1), r"^<!\[CDATA\[|\]\]>$", "")), F.lit(""))
    r = bodies.select("board", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<position>(.*?)</position>"), F.lit(1))).alias("x"))
    plain = F.regexp_replace("x", r"(?s)<jobDescriptions>.*?</jobDescriptions>", "")
    values = F.transform(F.regexp_extract_all("x", F.lit(r"(?s)<value>(.*?)</value>"), F.lit(1)), lambda v: F.trim(F.regexp_replace(F.trim(v), r"^<!\[CDATA\[|\]\]>$", "")))
    url = F.concat(F.lit("https://"), "board", F.lit(".jobs.personio.de/job/"), tag(plain, "id"))
    return _posting(r, tag(plain, "id"), tag(plain, "name"), url, tag(plain, "office"), scalars.iso_date(tag(plain, "createdAt")), F.array_join(values, "\n"))


def smartrecruiters(bodies: DataFrame) -> DataFrame:
    """List HTML: sections with a place and links whose address ends in digits."""
    section = F.explode(F.regexp_extract_all("body", F.lit(r'(?s)<section[^>]*class="[^"]*openings-section[^"]*"[^>]*>(.*?)</section>'), F.lit(1)))
    r = bodies.select("board", section.alias("s")).select("board", scalars.html_text(F.regexp_extract("s", r"(?s)<h3[^>]*>(.*?)</h3>", 1)).alias("place"), F.explode(F.regexp_extract_all("s", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("j"))
    url = F.regexp_extract("j", r'href="([^"]+)"', 1)
    return _posting(r, F.regexp_extract(url, r"/(\d+)[^/]*$", 1), scalars.html_text(F.regexp_extract("j", r'(?s)<h4[^>]*class="[^"]*job-title[^"]*"[^>]*>(.*?)</h4>', 1)), url, F.col("place"), _none("date"), _none())


def nalgoo(bodies: DataFrame) -> DataFrame:
    """JSON array: numeric id, title, location, publishedOn."""
    r = _rows(bodies, "array<struct<id:string,title:string,url:string,location:string,publishedOn:string,content:string>>").where(F.col("j.id").rlike("^[0-9]+$"))
    return _posting(r, F.col("j.id"), F.col("j.title"), F.col("j.url"), F.col("j.location"), scalars.iso_date(F.col("j.publishedOn")), F.col("j.content"))


def oracle_cloud(bodies: DataFrame, country: str | None = None) -> DataFrame:
    """items[].requisitionList[]: of a country if the primary or any secondary place is there."""
    item = "struct<Id:string,Title:string,PrimaryLocation:string,PrimaryLocationCountry:string,PostedDate:string,secondaryLocations:array<struct<Name:string,CountryCode:string>>>"
    r = _rows(bodies, f"items array<struct<requisitionList:array<{item}>>>", "items").select("board", F.explode("j.requisitionList").alias("j"))
    if country:
        r = r.where((F.col("j.PrimaryLocationCountry") == country) | F.coalesce(F.exists("j.secondaryLocations", lambda x: x["CountryCode"] == country), F.lit(False)))
    return _posting(r, F.col("j.Id"), F.col("j.Title"), F.concat_ws("/", F.lit("https:/"), "board", F.lit("job"), "j.Id"), F.col("j.PrimaryLocation"), scalars.iso_date(F.col("j.PostedDate")), _none())


def workday(bodies: DataFrame, today: Column) -> DataFrame:
    """jobPostings[]: externalPath, title, locationsText ("N Locations" is no place), relative postedOn."""
    r = _rows(bodies, "jobPostings array<struct<externalPath:string,title:string,locationsText:string,postedOn:string>>", "jobPostings")
    place = F.when(~F.col("j.locationsText").rlike(r"(?i)^\d+ locations?$"), F.col("j.locationsText"))
    return _posting(r, F.col("j.externalPath"), F.col("j.title"), F.concat(F.lit("https://"), "board", "j.externalPath"), place, scalars.relative_date(F.col("j.postedOn"), today), _none())


def taleo(bodies: DataFrame) -> DataFrame:
    """requisitionList[]: contestNo, column[0] the title, column[1] a JSON list of places."""
    r = _rows(bodies, "requisitionList array<struct<contestNo:string,column:array<string>>>", "requisitionList")
    where = F.coalesce(F.array_join(F.from_json(F.get("j.column", 1), "array<string>"), "; "), F.get("j.column", 1))
    return _posting(r, F.col("j.contestNo"), F.get("j.column", 0), F.concat(F.lit("https://"), "board", F.lit("/careersection/jobdetail.ftl?job="), "j.contestNo"), where, _none("date"), _none())


def taleo_blocks(text: Column) -> Column:
    """Distinct texts between !*! marks, percent-decoded where that is possible."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"!\*!"), lambda x: F.trim(keys.percent_decoded(x))), lambda x: x != ""))


def state_portal(bodies: DataFrame) -> DataFrame:
    """JSON list of the state portal: uuid, nazovPracovnehoMiesta, miestoVykonuPrace, url."""
    r = _rows(bodies, "array<struct<uuid:string,nazovPracovnehoMiesta:string,miestoVykonuPrace:string,url:string,datumVytvorenia:string>>")
    number = keys.offer_number(F.lit(None).cast("string"), F.col("j.url"))
    own = F.coalesce(F.nullif("j.uuid", F.lit("")), F.concat(F.lit("profesia:"), number), F.col("j.url"))
    return _posting(r, own, F.col("j.nazovPracovnehoMiesta"), F.col("j.url"), F.col("j.miestoVykonuPrace"), F.coalesce(scalars.portal_date(F.col("j.datumVytvorenia")), scalars.iso_date(F.col("j.datumVytvorenia"))), _none())


def sitemap(bodies: DataFrame) -> DataFrame:
    """(employer, ad_number, url): of each employer in a sitemap's addresses the smallest ad; slugs
    that stand for two full names are left out."""
    loc = F.explode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")
    r = bodies.select(loc).select("url", F.regexp_extract("url", r"/praca/([^/]+)/O(\d+)", 1).alias("full"), F.regexp_extract("url", r"/praca/([^/]+)/O(\d+)", 2).alias("number")).where("number <> ''")
    r = r.withColumn("employer", F.regexp_replace("full", keys.LEGAL_END, ""))
    g = r.groupBy("employer").agg(F.count_distinct("full").alias("names"), F.min(F.struct(F.col("number").cast("long").alias("n"), "number", "url")).alias("m")).where("names = 1")
    return g.select("employer", F.col("m.number").alias("ad_number"), F.col("m.url").alias("url"))


def _json_ld(html: str) -> dict | None:
    """The first JobPosting of a page's linked data (a list, a @graph or a type list included)."""
    for m in re.finditer(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>', html or ""):
        try:
            todo = [json.loads(m[1].strip())]
        except ValueError:
            continue
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = x + todo
            elif isinstance(x, dict):
                kind = x.get("@type")
                if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
                    return x
                todo = [x.get("@graph")] + todo if x.get("@graph") else todo
    return None


def _place(x: object) -> str | None:
    parts = []
    for loc in x if isinstance(x, list) else [x]:
        a = loc.get("address", {}) if isinstance(loc, dict) else {}
        if isinstance(a, str):
            parts.append(a)
        elif isinstance(a, dict):
            country = a.get("addressCountry")
            names = [a.get("addressLocality"), a.get("addressRegion"), country.get("name") if isinstance(country, dict) else country]
            parts.append(", ".join(n for n in names if isinstance(n, str) and n))
    return "; ".join(p for p in parts if p) or None


def json_ld(pages: DataFrame) -> DataFrame:
    """schema.org JobPosting of pages (url, body); the page's address is the id."""

    @F.pandas_udf("struct<title:string,location:string,posted:string,content:string>")
    def parse(bodies: pd.Series) -> pd.DataFrame:
        text = lambda v: v if isinstance(v, str) else None
        found = [_json_ld(b) or {} for b in bodies]
        return pd.DataFrame({"title": [text(x.get("title")) for x in found], "location": [_place(x.get("jobLocation")) for x in found], "posted": [text(x.get("datePosted")) for x in found], "content": [text(x.get("description")) for x in found]})

    r = pages.select(F.lit(None).cast("string").alias("board"), "url", parse("body").alias("j"))
    return _posting(r, F.col("url"), F.col("j.title"), F.col("url"), F.col("j.location"), scalars.iso_date(F.col("j.posted")), F.col("j.content"))


def _assigned_json(html: str, name: str = "phApp.ddo") -> dict:
    """The JSON object that a script assigns to a name; what follows it is ignored."""
    at = (html or "").find(name)
    begin = html.find("{", at) if at >= 0 else -1
    if begin < 0:
        return {}
    try:
        return json.JSONDecoder().raw_decode(html, begin)[0]
    except ValueError:
        return {}


def phenom(bodies: DataFrame) -> DataFrame:
    """Jobs in the object that a page's script assigns: jobId, title, location, postedDate."""

    @F.pandas_udf("array<struct<id:string,title:string,location:string,posted:string>>")
    def parse(pages: pd.Series) -> pd.Series:
        out = []
        for html in pages:
            jobs = _assigned_json(html).get("eagerLoadRefineSearch", {}).get("data", {}).get("jobs", [])
            out.append([{"id": str(j.get("jobId") or ""), "title": j.get("title"), "location": j.get("location"), "posted": j.get("postedDate")} for j in jobs if isinstance(j, dict)])
        return pd.Series(out)

    r = bodies.select("board", F.explode(parse("body")).alias("j"))
    return _posting(r, F.col("j.id"), F.col("j.title"), F.concat(F.lit("https://"), "board", F.lit("/job/"), "j.id"), F.col("j.location"), scalars.iso_date(F.col("j.posted")), _none())


def anchors(html: str) -> list[tuple[str, str]]:
    """(address, text) of a page's links."""
    return [(unescape(m[1]), " ".join(unescape(re.sub(r"<[^>]*>", " ", m[2])).split())) for m in re.finditer(r'(?is)<a\b[^>]*?href\s*=\s*"([^"#]+)[^"]*"[^>]*>(.*?)</a\s*>', html or "")]


#: Path words of pages that list openings.
CAREER_PATH = r"(?i)/(career|careers|kariera|jobs?|praca|volne-pozicie|pracovne-ponuky|karriere|stellen[a-z]*|allas[a-z]*)(/|$)"


def career_page(bodies: DataFrame) -> DataFrame:
    """A company's own page: the largest group of links with one parent under a career path."""

    @F.pandas_udf("array<struct<url:string,title:string>>")
    def links(pages: pd.Series) -> pd.Series:
        return pd.Series([[{"url": u, "title": t} for u, t in anchors(p)] for p in pages])

    r = bodies.select("board", F.explode(links("body")).alias("j")).select("board", F.col("j.url").alias("url"), F.col("j.title").alias("title")).where("title <> ''")
    r = r.withColumn("parent", F.regexp_replace("url", r"/[^/]*/?$", "/")).where(F.col("parent").rlike(CAREER_PATH)).dropDuplicates(["board", "url"])
    top = r.groupBy("board", "parent").agg(F.count("*").alias("n")).groupBy("board").agg(F.max_by("parent", F.struct("n", "parent")).alias("parent"))
    return _posting(r.join(top, ["board", "parent"]), keys.clean_address(F.col("url")), F.col("title"), F.col("url"), _none(), _none("date"), _none())


def offer_page(pages: DataFrame) -> DataFrame:
    """Microdata of an ad page (num, body): h1, employer of the title, address, date; none without h1."""
    own = lambda prop: F.nullif(scalars.html_text(F.regexp_extract("body", rf'(?s)itemprop="{prop}"[^>]*>(.*?)</', 1)), F.lit(""))
    title = F.nullif(scalars.html_text(F.regexp_extract("body", r"(?s)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))
    page = scalars.html_text(F.regexp_extract("body", r"(?s)<title>(.*?)</title>", 1))
    return pages.select("num", title.alias("title"), F.trim(F.regexp_extract(page, r"^(?:.*, )?([^,|]+?)\s*\|", 1)).alias("employer"), own("address").alias("location"), scalars.iso_date(F.regexp_extract("body", r'itemprop="datePosted"[^>]*content="([^"]+)"', 1)).alias("posted")).where("title IS NOT NULL")


def accumulate(pages: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, reads) of paged boards. pages: postings with page_no; outcomes: board, page_no, ok,
    total (declared, may be null), rows, budget (pages allowed). Of a repeated id the first page
    counts. A read is UNAVAILABLE if its first page failed, else PARTIAL with a reason or COMPLETE."""
    first = pages.withColumn("r", F.row_number().over(Window.partitionBy("board", "external_id").orderBy("page_no", "title"))).where("r = 1").drop("r")
    got = first.groupBy("board").agg(F.count("*").alias("got"))
    per = outcomes.groupBy("board").agg(
        F.min(F.when(~F.col("ok"), F.col("page_no"))).alias("failed"), F.max("total").alias("total"), F.min(F.when(F.col("ok") & (F.col("rows") == 0), F.col("page_no"))).alias("empty"), F.count("*").alias("n"), F.max("budget").alias("budget"), F.min("page_no").alias("low")
    ).join(got, "board", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    short = F.col("total").isNotNull() & (F.col("got") < F.col("total"))
    state = (
        F.when(F.col("failed") == F.col("low"), "UNAVAILABLE")
        .when(F.col("failed").isNotNull(), "PARTIAL:PAGE_FAILED")
        .when(F.col("empty").isNotNull() & short, "PARTIAL:LIST_ENDED_EARLY")
        .when(short & (F.col("n") >= F.col("budget")), "PARTIAL:PAGE_LIMIT")
        .when(short, "PARTIAL:LIST_ENDED_EARLY")
        .otherwise("COMPLETE")
    )
    return first, per.select("board", "got", state.alias("state"))


PARSERS = {"GREENHOUSE": greenhouse, "PERSONIO": personio, "SMARTRECRUITERS": smartrecruiters, "NALGOO": nalgoo, "ORACLE": oracle_cloud, "TALEO": taleo, "PHENOM": phenom, "STATE_PORTAL": state_portal, "CAREER_PAGE": career_page}
