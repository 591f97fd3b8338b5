"""Demonstration queries of work queues, checked pages, addresses, details and small lists."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from postlake.functions import keys
from postlake.matching import brands
from postlake.operators.resolve import shared_folder
from postlake.plans import market
from postlake.plans.domain import Domain, duck
from postlake.plans.registry import Registry
from postlake.sources import employers, pages

R = Registry()
C = F.col
BEFORE = dt.datetime(2024, 1, 8)

# companies, portal employers and boards of the work queues; numbers with and without leading zeros
_COMPANY = """SELECT c_custkey AS id, c_name AS name, CASE c_nationkey % 3 WHEN 0 THEN 'SK' WHEN 1 THEN 'CZ' ELSE 'DE' END AS country, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS {text}), 8, '0') ELSE CAST(c_custkey AS {text}) END AS registration_number,
  CASE WHEN c_custkey % 13 = 0 THEN DATE '2024-01-10' END AS terminated_on, c_custkey % 4 AS priority, CASE WHEN c_acctbal > 2000 THEN TIMESTAMP_NTZ '2024-01-05 00:00:00' WHEN c_acctbal > 0 THEN TIMESTAMP_NTZ '2024-01-09 00:00:00' END AS employees_checked_at FROM {customer}"""
_EMPLOYER = """SELECT DISTINCT lpad(CAST(o_custkey AS {text}), 8, '0') AS registration_number, CASE o_custkey % 3 WHEN 0 THEN TIMESTAMP_NTZ '2024-01-09 00:00:00' WHEN 1 THEN TIMESTAMP_NTZ '2024-01-04 00:00:00' END AS site_checked_at,
  CASE o_custkey % 5 WHEN 0 THEN TIMESTAMP_NTZ '2024-01-09 00:00:00' WHEN 1 THEN TIMESTAMP_NTZ '2024-01-02 00:00:00' END AS profesia_checked_at FROM {orders}"""
_BOARD = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'stateportal' ELSE 'workday' END AS provider, lpad(CAST(c_custkey AS {text}), 8, '0') AS board FROM {customer}"
_POSTED = """SELECT o_custkey AS source_id, CASE WHEN o_orderpriority < '4' THEN 'profesia:' ELSE 'x:' END || o_orderkey AS external_id, 'https://p/' || o_orderkey AS url, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP_NTZ '2024-01-01 00:00:00' END AS closed_at,
  CAST(o_orderdate AS {ntz}) AS last_confirmed_at FROM {orders}"""


def _frame(t, text: str):
    frames = {x: t(x) for x in ("customer", "orders") if "{" + x + "}" in text}
    text = text.replace("{text}", "STRING").replace("{ntz}", "TIMESTAMP_NTZ")
    return next(iter(frames.values())).sparkSession.sql(text, **frames)


def _sql(body: str) -> str:
    views = {"company": _COMPANY, "employer": _EMPLOYER, "board": _BOARD, "posted": _POSTED}
    text = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in views.items() if f"{k} " in body) + body
    return text.replace("{text}", "VARCHAR").replace("{ntz}", "TIMESTAMP").replace("{customer}", "customer").replace("{orders}", "orders").replace("TIMESTAMP_NTZ", "TIMESTAMP")


def _countries(t):
    """(country, active): that of the first region's nations is collected."""
    return t("nation").groupBy(F.when(C("n_nationkey") % 3 == 0, "SK").when(C("n_nationkey") % 3 == 1, "CZ").otherwise("DE").alias("country")).agg(F.bool_or(C("n_regionkey") >= 0).alias("active"))


@R.add("q21_size_queue", _sql(f" SELECT id, registration_number FROM company c WHERE country = 'SK' AND terminated_on IS NULL AND coalesce(employees_checked_at < TIMESTAMP '{BEFORE}', true) ORDER BY priority DESC, employees_checked_at NULLS FIRST, id LIMIT 60"))
def sizes(t):
    return market.sizes_to_check(_frame(t, _COMPANY), _countries(t), "SK", BEFORE, 60)


_OWN = "FROM employer e JOIN company c ON ltrim(c.registration_number, '0') = ltrim(e.registration_number, '0') AND c.country = 'SK' AND c.terminated_on IS NULL"


@R.add("q21_employer_site_queue", _sql(f" SELECT e.registration_number AS number, c.id AS company_id, c.name {_OWN} WHERE coalesce(e.site_checked_at < TIMESTAMP '{BEFORE}', true) ORDER BY c.priority DESC, e.site_checked_at NULLS FIRST, 1, 2 LIMIT 60"))
def employer_sites(t):
    return market.employers_for_sites(_frame(t, _EMPLOYER), _frame(t, _COMPANY), _countries(t), "SK", BEFORE, 60)


@R.add("q21_employer_offer_queue", _sql(f""" SELECT number, company_id, url FROM (SELECT e.registration_number AS number, c.id AS company_id, p.url, c.priority, e.profesia_checked_at AS checked, row_number() OVER (PARTITION BY e.registration_number ORDER BY p.last_confirmed_at DESC, p.url) AS r
  {_OWN} JOIN board b ON b.board = e.registration_number AND b.provider = 'stateportal' JOIN posted p ON p.source_id = b.id AND p.closed_at IS NULL AND p.external_id LIKE 'profesia:%' WHERE coalesce(e.profesia_checked_at < TIMESTAMP '{BEFORE}', true)) x
WHERE r = 1 ORDER BY priority DESC, checked NULLS FIRST, number LIMIT 60"""))
def employer_offers(t):
    return market.employers_for_offers(_frame(t, _EMPLOYER), _frame(t, _COMPANY), _countries(t), _frame(t, _BOARD), _frame(t, _POSTED), "stateportal", "SK", BEFORE, 60)


# a site is the company's if its brand is in the host and in the text of the page

_HOST = "CASE p_partkey % 5 WHEN 0 THEN w WHEN 1 THEN w || '-' || k WHEN 2 THEN 'my' || w || 's' WHEN 3 THEN 'other' ELSE w || k END || CASE WHEN p_size % 2 = 0 THEN '.sk' ELSE '.com' END"
_SAID = "repeat('stránka o nás ', CAST(p_size AS INT) % 20 + 6) || CASE p_size % 3 WHEN 0 THEN w || ' ' || upper(k) WHEN 1 THEN w ELSE w || k END || CASE WHEN p_partkey % 3 = 0 THEN ' Slovensko' ELSE '' END"


@R.add("p10_confirmed_pages", f"""SELECT p_partkey, n >= 30 AND NOT parked AND (domestic OR said LIKE '%Slovensko%') AND (pair OR one AND regexp_matches(lower(said), '\\b' || k || '\\b')) AS confirmed FROM
  (SELECT *, 3 * (CAST(p_size AS INT) % 20 + 6) + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS n, p_partkey % 11 = 0 AS parked, host LIKE '%.sk' AS domestic, host LIKE '%' || w || '%' AND regexp_matches(said, '\\b' || w || '\\b') AS one, replace(host, '-', '') LIKE w || k || '%' AND regexp_matches(said, '\\b' || w || k || '\\b') AS pair
   FROM (SELECT *, {_HOST} AS host, {_SAID} AS said FROM (SELECT *, split_part(p_name, ' ', 2) AS w, lower(p_type) AS k FROM part)))""")
def confirmed(t):
    p = t("part").select("*", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w"), F.lower("p_type").alias("k"))
    name = F.concat(F.initcap("w"), F.lit(" "), "k", F.lit(" s.r.o."))
    html = F.when(C("p_partkey") % 11 == 0, "<p>This domain is for sale</p>").otherwise("<p>")
    return p.select("p_partkey", brands.page_confirmed(name, F.concat(F.lit("www."), F.expr(_HOST)), C("p_name"), F.expr(_SAID), html).alias("confirmed"))


# addresses of listed postings keep what tells them apart


_LISTED = """CASE WHEN page_id % 6 = 5 THEN url ELSE split_part(url, '#', 1) END || CASE WHEN page_id % 6 = 5 THEN '' WHEN url LIKE '%?%' THEN '&' ELSE '?' END || CASE page_id % 6 WHEN 0 THEN 'search_id=' || page_id || '&id=5' WHEN 1 THEN 'id=5&utm_source=x&utm_medium=y#top'
  WHEN 2 THEN 'filter=tpp' WHEN 3 THEN 'filter=tpp#a?b' WHEN 4 THEN 'utm_term=a&&id=7&search_id=1' ELSE '' END"""


@R.add("x18_without_session", f"""SELECT page_id, base || CASE WHEN len(kept) = 0 THEN '' WHEN list_position(parts, kept[1]) > 2 THEN '?&' ELSE '?' END || array_to_string(kept, '&') || mark AS external_id FROM
  (SELECT *, list_filter(parts, lambda x: x <> '' AND NOT (starts_with(x, 'utm_') OR starts_with(x, 'search_id=') OR starts_with(x, 'filter='))) AS kept FROM (SELECT page_id, split_part(main, '?', 1) AS base, mark, string_split(split_part(main, '?', 2), '&') AS parts
   FROM (SELECT page_id, split_part(a, '#', 1) AS main, regexp_extract(a, '#.*$') AS mark FROM (SELECT page_id, {_LISTED} AS a FROM pages))))""")
def without_session(t):
    return t("pages").select("page_id", keys.without_session(F.expr(_LISTED)).alias("external_id"))


# small lists


@R.add("s25_named_sources", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Caterpillar' WHEN 1 THEN 'Personio' WHEN 2 THEN s_name END AS employer_name FROM supplier""")
def named_sources(t):
    k = C("s_suppkey") % 4
    provider = F.when(k == 1, "personio").otherwise("workday")
    board = F.when(k == 0, "cat.wd5.myworkdayjobs.com/caterpillarcareers").when(k == 1, "personio.jobs.personio.de").otherwise(F.concat(F.lit("b"), C("s_suppkey").cast("string")))
    own = t("supplier").select("s_suppkey", provider.alias("provider"), board.alias("board"), F.when(k != 3, C("s_name")).alias("employer_name"))
    return employers.named(own).select("s_suppkey", "employer_name")


@R.add("s26_benchmark_list", "SELECT c_custkey AS rank, CASE WHEN c_custkey % 7 > 0 THEN c_name || ', \"a.s.\"' END AS name, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS registration_number, CASE WHEN c_nationkey % 2 = 0 THEN 'SK' END AS country, c_nationkey AS employees, false AS broken FROM customer")
def benchmark_list(t):
    c = t("customer").withColumn("number", F.lpad(C("c_custkey").cast("string"), 8, "0"))
    name = F.when(C("c_custkey") % 7 > 0, F.concat("c_name", F.lit(', "a.s."')))
    rows = c.select(C("c_custkey").alias("rank"), name.alias("name"), C("number").alias("registration_number"), F.when(C("c_nationkey") % 2 == 0, "SK").alias("country"), C("c_nationkey").alias("employees"))
    at = f"{shared_folder(c.sparkSession).rstrip('/')}/list-{uuid.uuid4().hex}"
    rows.write.option("header", "true").option("escape", '"').csv(at)
    return pages.benchmark_list(c.sparkSession, at).withColumn("broken", C("broken").isNotNull())


# a vacancy's details


@R.add("q04_details", duck(""", said AS (SELECT vacancy_id, language, bool_or(required) AS required FROM (SELECT l_orderkey AS vacancy_id, CASE l_linenumber WHEN 1 THEN 'en' WHEN 2 THEN 'de' WHEN 3 THEN 'en' WHEN 4 THEN 'hu' END AS language, l_quantity > 25 AS required FROM lineitem) WHERE language IS NOT NULL GROUP BY 1, 2),
listed AS (SELECT vacancy_id, string_agg(language || CASE WHEN required THEN '+' ELSE '' END, ',' ORDER BY language) AS languages FROM said GROUP BY 1)
SELECT v.id, v.state, s.status, coalesce(l.languages, '') AS languages FROM vacancy v LEFT JOIN user_status s ON s.vacancy_id = v.id AND s.user_id = 2 LEFT JOIN listed l ON l.vacancy_id = v.id
WHERE s.status IS NOT NULL OR v.id IN (SELECT d.vacancy_id FROM delivered d JOIN condition c ON c.id = d.condition_id WHERE c.user_id = 2)"""))
def details(t):
    n = C("l_linenumber")
    said = t("lineitem").select(C("l_orderkey").alias("vacancy_id"), F.when(n.isin(1, 3), "en").when(n == 2, "de").when(n == 4, "hu").alias("language"), (C("l_quantity") > 25).alias("required"))
    shown = F.array_join(F.transform("languages", lambda x: F.concat(x["language"], F.when(x["required"], "+").otherwise(""))), ",")
    return market.details(Domain(t), 2, said).select("id", "state", "status", shown.alias("languages"))
