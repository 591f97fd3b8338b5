"""Demonstration queries of the domain's named plans.

The domain tables are derived from the driver's by portable SELECTs, written once for both engines
(ARR(...) is an array literal).
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from postlake.plans import market
from postlake.plans.registry import Registry

R = Registry()
NOW, DAY = dt.datetime(2024, 2, 1, 12), dt.date(2024, 1, 15)
BEGIN, END = dt.datetime(2024, 1, 14, 23), dt.datetime(2024, 1, 15, 23)

VIEWS = {
    "company": """SELECT c_custkey AS id, c_name AS name, CASE c_nationkey % 3 WHEN 0 THEN 'SK' WHEN 1 THEN 'CZ' ELSE 'DE' END AS country, c_custkey % 17 = 0 AS agency, c_custkey % 19 = 0 AS not_employer,
      c_custkey % 23 = 0 AS no_own_career_page, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP_NTZ '2024-01-20 00:00:00' ELSE TIMESTAMP_NTZ '2024-01-02 00:00:00' END AS first_seen_at,
      CASE WHEN c_custkey % 13 = 0 THEN DATE '2024-01-10' END AS terminated_on, CASE WHEN c_custkey % 29 = 0 THEN TIMESTAMP_NTZ '2024-03-01 00:00:00' END AS loss_postponed_until FROM customer""",
    "company_check": """SELECT c_custkey AS company_id, CASE c_custkey % 3 WHEN 0 THEN 'CONNECTED' WHEN 1 THEN 'NO_CAREER_PAGE' ELSE 'UNREACHABLE' END AS result,
      CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP_NTZ '2024-01-30 00:00:00' ELSE TIMESTAMP_NTZ '2024-01-05 00:00:00' END AS first_checked_at FROM customer WHERE c_acctbal > 500""",
    "source": """SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'GREENHOUSE' WHEN 1 THEN 'WORKDAY' WHEN 2 THEN 'PORTAL' WHEN 3 THEN 'PROFESIA' ELSE 'PERSONIO' END AS provider,
      CASE s_suppkey % 4 WHEN 0 THEN 'SK' WHEN 1 THEN 'CZ' END AS country, CASE s_suppkey % 6 WHEN 0 THEN 'UNAVAILABLE' WHEN 1 THEN 'TEMP_FAILING' ELSE 'OK' END AS availability,
      TIMESTAMP_NTZ '2024-01-03 00:00:00' AS created_at, CASE WHEN s_suppkey % 11 = 0 THEN TIMESTAMP_NTZ '2024-01-09 00:00:00' END AS closed_at FROM supplier""",
    "company_source": """SELECT DISTINCT o_custkey AS company_id, l_suppkey AS source_id, CASE (o_custkey + l_suppkey) % 5 WHEN 0 THEN 'GROUP' WHEN 1 THEN 'AGENCY' ELSE 'EMPLOYER' END AS role
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_quantity <= 6""",
    "company_site": """SELECT p_partkey AS id, 1 + p_partkey % 1500 AS company_id, CASE p_partkey % 3 WHEN 0 THEN 'FOUND' WHEN 1 THEN 'CANDIDATE' ELSE 'REJECTED' END AS status, p_brand AS proof, CASE WHEN p_size % 4 = 0 THEN 'COMMON_CRAWL' ELSE 'SEARCH' END AS source,
      CASE p_size % 7 WHEN 0 THEN 'SOURCE_FOUND' WHEN 1 THEN 'FORMAT_UNSUPPORTED' WHEN 2 THEN 'PORTAL_ONLY' WHEN 3 THEN 'NO_CAREER_PAGE' WHEN 4 THEN 'UNREACHABLE' WHEN 5 THEN 'USE_FORBIDDEN' END AS check_result,
      TIMESTAMP_NTZ '2024-01-06 00:00:00' AS found_at, CASE WHEN p_size % 8 <> 0 THEN TIMESTAMP_NTZ '2024-01-07 00:00:00' END AS checked_at FROM part""",
    "vacancy": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'ACTIVE' ELSE 'NEEDS_RECHECK' END AS state, 'v' || o_orderkey AS title,
      CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP_NTZ '2024-01-15 10:00:00' ELSE TIMESTAMP_NTZ '2024-01-12 10:00:00' END AS first_seen_at,
      CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP_NTZ '2024-01-15 12:00:00' ELSE TIMESTAMP_NTZ '2024-01-16 12:00:00' END END AS closed_at,
      CASE WHEN o_orderkey % 8 = 0 THEN TIMESTAMP_NTZ '2023-12-01 00:00:00' ELSE TIMESTAMP_NTZ '2024-01-28 00:00:00' END AS last_confirmed_at,
      CASE o_orderkey % 10 WHEN 0 THEN TIMESTAMP_NTZ '2023-06-01 00:00:00' WHEN 1 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE TIMESTAMP_NTZ '2024-01-11 00:00:00' END AS posted_at,
      CASE o_custkey % 6 WHEN 0 THEN ARR('SK') WHEN 1 THEN ARR('CZ', 'SK') WHEN 2 THEN ARR('*') WHEN 3 THEN ARR('DE') WHEN 4 THEN EMPTY() END AS work_countries,
      CASE o_orderkey % 4 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'HYBRID' WHEN 2 THEN 'OFFICE' END AS work_format FROM orders""",
    "job_posting": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS vacancy_id, l_suppkey AS source_id, 'profesia:' || (10000 + l_partkey) AS external_id, 'Title ' || (l_partkey % 40) || CASE WHEN l_linenumber = 2 THEN ' (m/z)' ELSE '' END AS title,
      CASE WHEN l_returnflag = 'R' THEN TIMESTAMP_NTZ '2024-01-08 00:00:00' END AS closed_at, CASE WHEN l_quantity > 40 THEN 'G' || (l_partkey % 6) END AS occupation_code, CASE WHEN l_quantity < 5 THEN 'G' || (l_partkey % 6) END AS title_occupation_code FROM lineitem""",
    "position": "SELECT p_size AS id, 'P' || p_size AS code, 'G' || (p_size % 6) AS occupation_code FROM part GROUP BY p_size",
    "vacancy_position_match": "SELECT DISTINCT l_orderkey AS vacancy_id, p_size AS position_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 AND l_returnflag <> 'A'",
    "condition": "SELECT n_nationkey AS id, n_regionkey AS user_id, CASE n_nationkey % 3 WHEN 0 THEN ARR('SK') WHEN 1 THEN ARR('CZ', 'DE') ELSE ARR('SK', 'CZ') END AS countries, CASE n_nationkey % 4 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'OFFICE' END AS work_format FROM nation",
    "condition_position": "SELECT n_nationkey AS condition_id, 1 + n_nationkey * 2 AS position_id FROM nation",
    "condition_occupation": "SELECT n_nationkey AS condition_id, 'G' || (n_nationkey % 8) AS code FROM nation",
    "offer_position": "SELECT 10000 + p_partkey AS num, 'G' || (p_size % 6) AS code FROM part WHERE p_size <= 6",
    "user_status": "SELECT o_custkey % 5 AS user_id, o_orderkey AS vacancy_id, CASE o_orderkey % 3 WHEN 0 THEN 'VIEWED' WHEN 1 THEN 'APPLIED' ELSE 'NOT_INTERESTED' END AS status FROM orders WHERE o_orderpriority = '1-URGENT'",
    "delivered": "SELECT o_orderkey % 25 AS condition_id, o_orderkey AS vacancy_id FROM orders WHERE o_totalprice > 200000",
    "crawl_run": """SELECT event_id AS id, 1 + user_id % 100 AS source_id, ts AS started_at, ts AS finished_at, CASE event_type WHEN 'click' THEN 'COMPLETE' WHEN 'view' THEN 'COMPLETE' WHEN 'error' THEN 'FAILED' ELSE 'PARTIAL' END AS state,
      CASE event_type WHEN 'error' THEN 'TIMEOUT' WHEN 'signup' THEN 'PAGE_LIMIT' ELSE 'COUNT_DROP' END AS reason FROM events""",
    "task": "SELECT event_id AS id, event_type AS type, CASE WHEN value > 50 THEN 'FAILED' ELSE 'DONE' END AS state, ts AS updated_at FROM events",
    "benchmark_company": "SELECT r AS rank, CASE WHEN r % 5 = 0 THEN NULL ELSE r END AS company_id FROM (SELECT c_custkey AS r FROM customer WHERE c_mktsegment = 'BUILDING') x",
}


def spark_text(sql: str) -> str:
    return sql.replace("ARR(", "array(").replace("EMPTY()", "cast(array() AS array<string>)")


def duck_text(sql: str) -> str:
    sql = re.sub(r"ARR\(([^)]*)\)", r"[\1]", sql).replace("EMPTY()", "CAST([] AS VARCHAR[])")
    return sql.replace("TIMESTAMP_NTZ '", "TIMESTAMP '").replace("AS TIMESTAMP_NTZ", "AS TIMESTAMP")


def duck(sql: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({duck_text(v)})" for k, v in VIEWS.items() if re.search(rf"\b{k}\b", sql)) + sql


class Domain(dict):
    """Domain tables, derived when they are asked for."""

    def __init__(self, read):
        super().__init__()
        self.read = read

    def __contains__(self, name) -> bool:
        return name in VIEWS

    def __missing__(self, name: str):
        used = [x for x in ("customer", "supplier", "orders", "lineitem", "part", "nation", "events") if re.search(rf"\b{x}\b", VIEWS[name])]
        frames = {x: self.read(x) for x in used}
        text = spark_text(VIEWS[name])
        for x in used:
            text = re.sub(rf"\b(FROM|JOIN) {x}\b", rf"\1 {{{x}}}", text)
        self[name] = next(iter(frames.values())).sparkSession.sql(text, **frames)
        return self[name]


_HITS = f"""hits AS (SELECT DISTINCT h.condition_id, h.code, h.vacancy_id FROM (
  SELECT s.condition_id, p.code, m.vacancy_id FROM condition_position s JOIN position p ON p.id = s.position_id JOIN vacancy_position_match m ON m.position_id = s.position_id
  UNION ALL SELECT o.condition_id, o.code, j.vacancy_id FROM condition_occupation o JOIN job_posting j ON j.occupation_code = o.code
  UNION ALL SELECT o.condition_id, o.code, m.vacancy_id FROM condition_occupation o JOIN position p ON p.occupation_code = o.code JOIN vacancy_position_match m ON m.position_id = p.id
  UNION ALL SELECT o.condition_id, o.code, j.vacancy_id FROM condition_occupation o JOIN job_posting j ON j.title_occupation_code = o.code
  UNION ALL SELECT o.condition_id, o.code, j.vacancy_id FROM condition_occupation o JOIN offer_position f ON f.code = o.code JOIN job_posting j ON j.external_id = 'profesia:' || f.num) h
  JOIN vacancy v ON v.id = h.vacancy_id WHERE v.posted_at IS NULL OR v.posted_at > TIMESTAMP '{NOW}' - INTERVAL 4 MONTHS)"""
_FIT = f""", {_HITS}, fit AS (SELECT c.id AS condition_id, c.user_id, v.* FROM condition c JOIN (SELECT DISTINCT condition_id, vacancy_id FROM hits) h ON h.condition_id = c.id JOIN vacancy v ON v.id = h.vacancy_id
  WHERE v.state <> 'CLOSED' AND v.last_confirmed_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS AND (list_has_any(v.work_countries, c.countries) OR len(v.work_countries) = 0)
  AND (c.work_format IS NULL OR v.work_format IS NULL OR v.work_format IN ('CONFLICT', 'HYBRID', c.work_format)))"""


@R.add("q_search_matches", duck(f", {_HITS} SELECT condition_id, code, vacancy_id FROM hits"))
def matches(t):
    return market.search_matches(Domain(t), NOW).select("condition_id", "code", "vacancy_id")


@R.add("q05_delivery_portion", duck(_FIT + " SELECT f.condition_id, f.id AS vacancy_id, f.first_seen_at FROM fit f WHERE NOT EXISTS (SELECT 1 FROM user_status s WHERE s.user_id = f.user_id AND s.vacancy_id = f.id AND s.status <> 'VIEWED') AND NOT EXISTS (SELECT 1 FROM delivered d WHERE d.condition_id = f.condition_id AND d.vacancy_id = f.id)"))
def portion(t):
    return market.deliver_portion(Domain(t), NOW)


_VIS = _FIT + ", vis AS (SELECT f.*, s.status AS user_status, coalesce(f.posted_at, f.first_seen_at) AS opened FROM fit f JOIN delivered d ON d.condition_id = f.condition_id AND d.vacancy_id = f.id LEFT JOIN user_status s ON s.user_id = f.user_id AND s.vacancy_id = f.id WHERE s.status IS NULL OR s.status = 'VIEWED')"


@R.add("q01_result_counts", duck(_VIS + " SELECT condition_id, count(*) AS total, count(*) FILTER (user_status IS NULL) AS new FROM vis GROUP BY condition_id"))
def counts(t):
    return market.result_counts(market.visible(Domain(t), NOW))


@R.add("q01_result_page", duck(_VIS + " SELECT id AS vacancy_id, opened FROM vis WHERE condition_id = 3 ORDER BY opened DESC, id DESC LIMIT 20"))
def page(t):
    return market.result_page(market.visible(Domain(t), NOW), 3).select("vacancy_id", "opened")


@R.add("q02_facet_counts", duck(_VIS + " SELECT p.code, count(x.vacancy_id) AS total FROM (SELECT DISTINCT code FROM position) p LEFT JOIN (SELECT h.code, h.vacancy_id FROM hits h JOIN vis v ON v.condition_id = h.condition_id AND v.id = h.vacancy_id) x ON x.code = p.code GROUP BY p.code"))
def facet(t):
    d = Domain(t)
    return market.facet_counts(d, market.visible(d, NOW), NOW)


def _metrics_sql() -> str:
    day, begin, end = DAY, BEGIN, END
    known = f"known AS (SELECT id, country FROM company WHERE first_seen_at < TIMESTAMP '{end}' AND (terminated_on IS NULL OR terminated_on > DATE '{day}'))"
    proc = f"processed AS (SELECT k.id, k.country, c.result FROM known k JOIN company_check c ON c.company_id = k.id WHERE c.first_checked_at < TIMESTAMP '{end}')"
    placed = "placed AS (SELECT v.*, coalesce(x.c, '') AS country, (v.id IN (SELECT vacancy_id FROM vacancy_position_match) OR v.id IN (SELECT vacancy_id FROM job_posting WHERE occupation_code IS NOT NULL OR title_occupation_code IS NOT NULL)) AS rec FROM vacancy v LEFT JOIN LATERAL (SELECT DISTINCT unnest(v.work_countries) AS c) x ON TRUE)"
    src = "src AS (SELECT s.id, s.provider, s.availability, s.created_at, coalesce(s.country, (SELECT min(co.country) FROM company_source cs JOIN company co ON co.id = cs.company_id WHERE cs.source_id = s.id AND cs.role IN ('EMPLOYER', 'GROUP')), '') AS country FROM source s WHERE s.closed_at IS NULL)"
    sets = lambda d: f"GROUP BY GROUPING SETS ((country), (country, {d}))"
    dim = lambda d: f"CASE WHEN grouping({d}) = 1 THEN '' ELSE coalesce({d}, 'NONE') END AS dimension"
    within = lambda c: f"{c} >= TIMESTAMP '{begin}' AND {c} < TIMESTAMP '{end}'"
    parts = [
        f"SELECT country, m.metric, '' AS dimension, m.value FROM (SELECT k.country, count(*) AS a, count(c.company_id) AS b FROM known k LEFT JOIN company_check c ON c.company_id = k.id AND c.first_checked_at < TIMESTAMP '{end}' GROUP BY 1) q, LATERAL (VALUES ('companies_known', a), ('companies_processed', b), ('companies_remaining', a - b)) m(metric, value)",
        f"SELECT country, 'companies_with_site', {dim('proof')}, count(DISTINCT p.id) FROM processed p JOIN company_site s ON s.company_id = p.id AND s.status = 'FOUND' AND s.found_at < TIMESTAMP '{end}' {sets('proof')}",
        f"SELECT country, 'companies_connected', {dim('provider')}, count(DISTINCT id) FROM (SELECT p.id, p.country, s.provider FROM processed p LEFT JOIN company_source cs ON cs.company_id = p.id AND cs.role IN ('EMPLOYER', 'GROUP') LEFT JOIN source s ON s.id = cs.source_id WHERE p.result = 'CONNECTED') {sets('provider')}",
        f"SELECT country, 'companies_failed', {dim('result')}, count(*) FROM processed WHERE result <> 'CONNECTED' {sets('result')}",
        f"SELECT country, metric, '', count(*) FROM (SELECT country, CASE state WHEN 'ACTIVE' THEN 'vacancies_active' ELSE 'vacancies_recheck' END AS metric FROM placed WHERE state <> 'CLOSED' UNION ALL SELECT country, 'vacancies_recognized' FROM placed WHERE state <> 'CLOSED' AND rec UNION ALL SELECT country, 'vacancies_new' FROM placed WHERE {within('first_seen_at')} UNION ALL SELECT country, 'vacancies_closed' FROM placed WHERE {within('closed_at')}) GROUP BY 1, 2",
        f"SELECT country, 'sources', {dim('availability')}, count(*) FROM src {sets('availability')}",
        f"SELECT country, 'source_reads', {dim('o')}, count(*) FROM (SELECT DISTINCT ON (r.source_id) s.country, CASE r.state WHEN 'COMPLETE' THEN 'COMPLETE' WHEN 'PARTIAL' THEN 'PARTIAL:' || reason ELSE 'FAILED:' || reason END AS o FROM crawl_run r JOIN src s ON s.id = r.source_id WHERE {within('r.finished_at')} ORDER BY r.source_id, r.finished_at DESC, r.id DESC) {sets('o')}",
        f"SELECT country, 'sources_overdue', '', count(*) FROM src WHERE availability <> 'UNAVAILABLE' AND provider NOT IN ('PORTAL', 'PROFESIA') AND created_at < TIMESTAMP '{end}' - INTERVAL 24 HOURS AND NOT EXISTS (SELECT 1 FROM crawl_run r WHERE r.source_id = src.id AND r.started_at >= TIMESTAMP '{end}' - INTERVAL 24 HOURS AND r.started_at < TIMESTAMP '{end}') GROUP BY country",
        f"SELECT '', 'operations_failed', CASE WHEN grouping(type) = 1 THEN '' ELSE type END, count(*) FROM task WHERE state = 'FAILED' AND {within('updated_at')} GROUP BY GROUPING SETS ((), (type))",
    ]
    return duck(f", {known}, {proc}, {placed}, {src} SELECT '{day}' AS day, country, metric, dimension, value::BIGINT AS value FROM ({' UNION ALL '.join(parts)}) AS z(country, metric, dimension, value)")


@R.add("q07_daily_metrics", _metrics_sql())
def metrics(t):
    return market.daily_metrics(Domain(t), DAY, BEGIN, END)


_COV = """, p AS (SELECT cs.company_id, s.provider IN ('PORTAL', 'PROFESIA') AS portal, j.vacancy_id, trim(regexp_replace(regexp_replace(lower(j.title), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS k
  FROM company co JOIN company_source cs ON cs.company_id = co.id AND cs.role = 'EMPLOYER' JOIN source s ON s.id = cs.source_id AND s.closed_at IS NULL JOIN job_posting j ON j.source_id = s.id AND j.closed_at IS NULL
  JOIN vacancy v ON v.id = j.vacancy_id AND v.state <> 'CLOSED' AND (list_contains(v.work_countries, co.country) OR coalesce(len(v.work_countries), 0) = 0) WHERE co.terminated_on IS NULL AND NOT co.agency AND NOT co.not_employer),
pt AS (SELECT DISTINCT company_id, k FROM p WHERE portal), ot AS (SELECT DISTINCT company_id, k FROM p WHERE NOT portal), oc AS (SELECT company_id, count(DISTINCT vacancy_id) AS n FROM p WHERE NOT portal GROUP BY 1),
cov AS (SELECT c.company_id, co.country, c.portal_titles, c.found_on_own, coalesce(oc.n, 0) AS own_vacancies, CASE WHEN co.no_own_career_page THEN 'NO_OWN_PAGE'
  WHEN EXISTS (SELECT 1 FROM company_source cs JOIN source s ON s.id = cs.source_id WHERE cs.company_id = c.company_id AND cs.role = 'EMPLOYER' AND s.closed_at IS NULL AND s.provider NOT IN ('PORTAL', 'PROFESIA')) THEN CASE WHEN coalesce(oc.n, 0) > 0 THEN 'READ' ELSE 'READ_EMPTY' END
  WHEN EXISTS (SELECT 1 FROM company_source cs JOIN source s ON s.id = cs.source_id WHERE cs.company_id = c.company_id AND cs.role = 'GROUP' AND s.closed_at IS NULL) THEN 'GROUP_ONLY'
  ELSE coalesce((SELECT CASE min(CASE st.check_result WHEN 'SOURCE_FOUND' THEN 1 WHEN 'FORMAT_UNSUPPORTED' THEN 2 WHEN 'PORTAL_ONLY' THEN 3 WHEN 'NO_CAREER_PAGE' THEN 4 WHEN 'UNREACHABLE' THEN 5 WHEN 'USE_FORBIDDEN' THEN 6 ELSE 7 END)
    WHEN 1 THEN 'PAGE_FOUND' WHEN 2 THEN 'FORMAT_UNSUPPORTED' WHEN 3 THEN 'NO_OWN_PAGE' WHEN 4 THEN 'NO_CAREER_PAGE' WHEN 5 THEN 'UNREACHABLE' WHEN 6 THEN 'USE_FORBIDDEN' WHEN 7 THEN 'NOT_CHECKED' END FROM company_site st WHERE st.company_id = c.company_id AND st.status = 'FOUND'), 'NO_SITE') END AS channel
  FROM (SELECT pt.company_id, count(*) AS portal_titles, count(ot.company_id) AS found_on_own FROM pt LEFT JOIN ot ON ot.company_id = pt.company_id AND ot.k = pt.k GROUP BY 1) c JOIN company co ON co.id = c.company_id LEFT JOIN oc ON oc.company_id = c.company_id)"""


@R.add("q08_coverage", duck(_COV + " SELECT * FROM cov"))
def cover(t):
    return market.coverage(Domain(t))


@R.add("q08_coverage_metrics", duck(_COV + " SELECT country, metric, CASE WHEN grouping(channel) = 1 THEN '' ELSE channel END AS dimension, sum(v)::BIGINT AS value FROM (SELECT country, channel, m.metric, m.v FROM cov, LATERAL (VALUES ('coverage_companies', 1), ('coverage_portal_vacancies', portal_titles), ('coverage_found_on_own', found_on_own)) m(metric, v) WHERE channel <> 'NO_OWN_PAGE') GROUP BY GROUPING SETS ((country, metric), (country, metric, channel))"))
def cover_metrics(t):
    return market.coverage_metrics(market.coverage(Domain(t)))


@R.add("q09_loss_queue", duck(_COV + f" SELECT cov.*, portal_titles - found_on_own AS lost FROM cov JOIN company c ON c.id = cov.company_id WHERE channel IN {market.LOSSES} AND found_on_own < portal_titles AND NOT EXISTS (SELECT 1 FROM company_site s WHERE s.company_id = c.id AND s.status = 'FOUND' AND s.checked_at IS NULL) AND NOT c.no_own_career_page AND NOT c.not_employer AND c.terminated_on IS NULL AND (c.loss_postponed_until IS NULL OR c.loss_postponed_until <= TIMESTAMP '{NOW}')"))
def losses(t):
    d = Domain(t)
    return market.loss_queue(d, market.coverage(d), NOW)


_K = "trim(regexp_replace(regexp_replace(lower(j.title), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@R.add("q09_missing_titles", duck(f" SELECT cs.company_id, {_K} AS title_key, min(j.title) FILTER (s.provider IN ('PORTAL', 'PROFESIA')) AS title FROM company_source cs JOIN source s ON s.id = cs.source_id AND s.closed_at IS NULL JOIN job_posting j ON j.source_id = s.id AND j.closed_at IS NULL WHERE cs.role = 'EMPLOYER' GROUP BY 1, 2 HAVING bool_or(s.provider IN ('PORTAL', 'PROFESIA')) AND NOT bool_or(s.provider NOT IN ('PORTAL', 'PROFESIA'))"))
def missing(t):
    return market.missing_titles(Domain(t))


@R.add("q10_core_status", duck(" SELECT (SELECT count(*) FROM source WHERE closed_at IS NULL) AS sources, (SELECT count(*) FROM source WHERE closed_at IS NULL AND availability = 'UNAVAILABLE') AS unavailable, (SELECT count(*) FROM crawl_run WHERE started_at >= TIMESTAMP '2024-01-15 10:00:00') AS runs, (SELECT count(*) FROM crawl_run WHERE started_at >= TIMESTAMP '2024-01-15 10:00:00' AND state = 'FAILED') AS failed_runs, (SELECT count(*) FROM task WHERE state = 'FAILED') AS failed_tasks"))
def status(t):
    return market.core_status(Domain(t), dt.datetime(2024, 1, 15, 12))


@R.add("q15_employers", duck(" SELECT vacancy_id, employer FROM (SELECT j.vacancy_id, co.name AS employer, row_number() OVER (PARTITION BY j.vacancy_id ORDER BY cs.role = 'GROUP', co.id) AS r FROM job_posting j JOIN company_source cs ON cs.source_id = j.source_id AND cs.role IN ('EMPLOYER', 'GROUP') JOIN company co ON co.id = cs.company_id) WHERE r = 1"))
def employer(t):
    return market.employers(Domain(t))


_HEADS = """, h AS (SELECT trim(regexp_replace(regexp_replace(lower(title), '\\s*([|,/(–]|\\s-\\s).*$', ''), '\\s+', ' ', 'g')) AS head, occupation_code AS code FROM job_posting WHERE occupation_code IS NOT NULL),
n AS (SELECT head, code, count(*) AS n, sum(count(*)) OVER (PARTITION BY head)::BIGINT AS total FROM h WHERE length(head) BETWEEN 3 AND 500 GROUP BY 1, 2), learned AS (SELECT head, code, n, total FROM n WHERE n >= 0.3 * total AND total >= 2 QUALIFY row_number() OVER (PARTITION BY head ORDER BY n DESC, code DESC) = 1)"""


@R.add("q19_learn_heads", duck(_HEADS + " SELECT * FROM learned"))
def heads(t):
    return market.learn_heads(Domain(t)["job_posting"], share=0.3)


@R.add("q20_unrecognised", duck(_HEADS + f" SELECT {_K} AS title_key, count(*) AS n FROM job_posting j WHERE occupation_code IS NULL AND closed_at IS NULL AND trim(regexp_replace(regexp_replace(lower(title), '\\s*([|,/(–]|\\s-\\s).*$', ''), '\\s+', ' ', 'g')) NOT IN (SELECT head FROM learned) GROUP BY 1"))
def rest(t):
    p = Domain(t)["job_posting"]
    return market.unrecognised(p, market.learn_heads(p, share=0.3))


@R.add("q23_report_checks", duck(" SELECT coalesce(k.result, 'NOT_CHECKED') AS result, count(*) AS companies FROM benchmark_company b LEFT JOIN company_check k ON k.company_id = b.company_id WHERE b.company_id IS NOT NULL GROUP BY 1"))
def report1(t):
    return market.report_checks(Domain(t))


@R.add("q06_digest_due", "SELECT c_custkey FROM (SELECT c_custkey, TIMESTAMP '2024-01-15 07:30:00' AT TIME ZONE 'UTC' AT TIME ZONE CASE c_custkey % 3 WHEN 0 THEN 'Europe/Bratislava' WHEN 1 THEN 'America/New_York' ELSE 'Asia/Tokyo' END AS l FROM customer) WHERE hour(l) >= 8 AND (c_custkey % 4 = 0 OR c_custkey % 4 = 1 AND isodow(l) <= 5 OR c_custkey % 4 = 2 AND isodow(l) = 1 + c_custkey % 7)")
def due(t):
    k = F.col("c_custkey")
    users = t("customer").select("c_custkey", F.when(k % 3 == 0, "Europe/Bratislava").when(k % 3 == 1, "America/New_York").otherwise("Asia/Tokyo").alias("time_zone"), F.when(k % 4 == 0, "DAILY").when(k % 4 == 1, "WEEKDAYS").when(k % 4 == 2, "WEEKLY").otherwise("NEVER").alias("frequency"), (1 + k % 7).alias("digest_day"))
    return market.digest_due(users, dt.datetime(2024, 1, 15, 7, 30, tzinfo=dt.timezone.utc)).select("c_custkey")
