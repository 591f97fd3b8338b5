"""Demonstration queries of task queues, guards and cursors, and of the report on the benchmark list."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postlake.operators import queues
from postlake.plans import market
from postlake.plans.domain import Domain, duck
from postlake.plans.registry import Registry

R = Registry()
NOW = dt.datetime(2024, 1, 15, 12)
GROUPS = {"click": "portal", "view": "portal", "error": "board"}
_TASK = """SELECT event_id AS id, event_type AS type, CASE WHEN value > 60 THEN 'QUEUED' WHEN value > 40 THEN 'WAITING' WHEN value > 25 THEN 'RUNNING' ELSE 'DONE' END AS state,
  CASE WHEN value > 25 AND value <= 40 THEN ts END AS lease_until, CASE WHEN user_id % 5 = 0 THEN 'Group is busy' END AS last_error, ts AS updated_at, user_id % 3 AS claim_seq, user_id % 4 AS attempts FROM events"""


def _tasks(t):
    events = t("events")
    return events.sparkSession.sql(_TASK.replace("FROM events", "FROM {events}"), events=events)


_GROUP = "CASE WHEN type IN ('click', 'view') THEN 'portal' WHEN type = 'error' THEN 'board' END"


@R.add("r10_exclusive_fifo", f"""WITH t AS (SELECT *, {_GROUP} AS grp FROM ({_TASK}))
SELECT id, claim_seq + 1 AS claim_seq FROM t WHERE state = 'QUEUED' AND (grp IS NULL OR (
  NOT EXISTS (SELECT 1 FROM t b WHERE b.grp = t.grp AND b.state = 'RUNNING' AND b.lease_until > TIMESTAMP '2024-01-15 12:00:00')
  AND NOT EXISTS (SELECT 1 FROM t o WHERE o.grp = t.grp AND o.id < t.id AND o.state IN ('QUEUED', 'WAITING') AND o.last_error = 'Group is busy' AND o.updated_at > TIMESTAMP '2024-01-15 11:00:00')
  AND NOT EXISTS (SELECT 1 FROM t q WHERE q.grp = t.grp AND q.id < t.id AND q.state = 'QUEUED')))""")
def r10(t):
    return queues.claims(_tasks(t), NOW, 300, GROUPS, 3600).select("id", "claim_seq")


@R.add("r10_exclusive_fifo_later", f"""WITH t AS (SELECT *, {_GROUP} AS grp FROM ({_TASK}))
SELECT id, claim_seq + 1 AS claim_seq FROM t WHERE state = 'QUEUED' AND (grp IS NULL OR (
  NOT EXISTS (SELECT 1 FROM t b WHERE b.grp = t.grp AND b.state = 'RUNNING' AND b.lease_until > TIMESTAMP '2030-01-01 00:00:00')
  AND NOT EXISTS (SELECT 1 FROM t o WHERE o.grp = t.grp AND o.id < t.id AND o.state IN ('QUEUED', 'WAITING') AND o.last_error = 'Group is busy' AND o.updated_at > TIMESTAMP '2010-01-01 00:00:00')
  AND NOT EXISTS (SELECT 1 FROM t q WHERE q.grp = t.grp AND q.id < t.id AND q.state = 'QUEUED')))""")
def r10_later(t):
    """All leases are over; a task that waits for its group keeps its turn."""
    return queues.claims(_tasks(t), dt.datetime(2030, 1, 1), 300, GROUPS, 20 * 366 * 86_400).select("id", "claim_seq")


@R.add("r08_task_states", f"""WITH t AS ({_TASK}), x AS (SELECT id, attempts + 1 AS attempts FROM t WHERE state = 'RUNNING' AND lease_until <= TIMESTAMP '2024-01-15 12:00:00')
SELECT id, CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'QUEUED' END AS state, attempts, 'Lease expired' AS last_error FROM x""")
def r08(t):
    return queues.expired(_tasks(t), NOW, 3).select("id", "state", "attempts", "last_error")


@R.add("r08_fencing", f"SELECT id, 'DONE' AS state FROM ({_TASK}) WHERE state = 'RUNNING' AND claim_seq = id % 3")
def r08_fencing(t):
    tasks = _tasks(t)
    return queues.finished(tasks, tasks.select("id", (F.col("id") % 3).alias("claim_seq"), F.lit("DONE").alias("outcome")))


@R.add("r04_timeouts", duck(" SELECT id, last_confirmed_at < TIMESTAMP '2024-01-02 12:00:00' AS hidden FROM vacancy"))
def r04(t):
    return queues.timeouts(Domain(t)["vacancy"], dt.datetime(2024, 2, 1, 12)).select("id", "hidden")


@R.add("r05_monotone_dates", "SELECT k, strftime(min(d), '%Y-%m-%d') AS posted FROM (SELECT l_orderkey AS k, min(l_shipdate)::DATE AS d FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, o_orderdate::DATE FROM orders WHERE o_orderstatus <> 'F') GROUP BY k")
def r05(t):
    known = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_shipdate").cast("date").alias("posted"))
    read = t("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("posted"))
    return queues.earlier(known, read, "k", "posted").withColumn("posted", F.col("posted").cast("string"))


@R.add("r07_missing_days", "SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(DATE '2024-01-20', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS d) WHERE d NOT IN (SELECT ts::DATE FROM events)")
def r07(t):
    return queues.days_without(t("events"), "ts", dt.date(2024, 1, 20), dt.date(2024, 2, 5)).select(F.col("day").cast("string").alias("day"))


@R.add("r12_cursor", "SELECT event_id FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 500)")
def r12(t):
    return queues.after(t("events"), {"ts": dt.datetime(2024, 1, 10), "event_id": 500}).select("event_id")


@R.add("r14_shrink_guard", "SELECT p_partkey FROM part WHERE p_size > 5 AND (SELECT count(*) FROM part WHERE p_size > 5) * 2 >= (SELECT count(*) FROM part) UNION ALL SELECT p_partkey FROM part WHERE p_size > 45 AND (SELECT count(*) FROM part WHERE p_size > 45) * 2 >= (SELECT count(*) FROM part)")
def r14(t):
    p = t("part").select("p_partkey", "p_size")
    kept = [queues.unless_shrunk(p.where(f"p_size > {n}"), p).select("p_partkey") for n in (5, 45)]
    return kept[0].union(kept[1])


@R.add("r15_freshness_gate", "SELECT s_suppkey FROM supplier WHERE (SELECT max(ts) FROM events) >= TIMESTAMP '2024-01-13 12:00:00' UNION ALL SELECT s_suppkey FROM supplier WHERE (SELECT max(ts) FROM events) >= TIMESTAMP '2029-12-30 00:00:00'")
def r15(t):
    s = t("supplier").select("s_suppkey")
    return queues.if_fresh(s, t("events"), "ts", NOW).union(queues.if_fresh(s, t("events"), "ts", dt.datetime(2030, 1, 1)))


# the report on the benchmark list

# a company's checked sites as a list: what was found by other means, or else the first that the crawl index names
_CHECKED = """picked AS (SELECT company_id AS company, CASE WHEN count(*) = count(*) FILTER (source = 'COMMON_CRAWL') THEN [coalesce(arg_min({r: check_result}, id).r, 'none')]
  ELSE list(coalesce(check_result, 'none')) FILTER (source <> 'COMMON_CRAWL') END AS results FROM company_site WHERE status = 'FOUND' GROUP BY company_id)"""


@R.add("q23_report_registry", duck(""" SELECT CAST(sum(known) AS BIGINT) AS in_registry, CAST(sum(known * ended) AS BIGINT) AS terminated, CAST(sum(1 - known) AS BIGINT) AS not_in_registry
FROM (SELECT CASE WHEN company_id IS NULL THEN 0 ELSE 1 END AS known, CASE WHEN company_id IN (SELECT id FROM company WHERE terminated_on IS NOT NULL) THEN 1 ELSE 0 END AS ended FROM benchmark_company) x"""))
def registry(t):
    return market.report_registry(Domain(t))


@R.add("q23_report_sites", duck(""" SELECT count(w.company_id) AS site_found, count(*) AS in_registry FROM (SELECT company_id FROM benchmark_company WHERE company_id > 0) l
LEFT JOIN (SELECT DISTINCT company_id FROM company_site WHERE status = 'FOUND') w USING (company_id)"""))
def sites(t):
    return market.report_sites(Domain(t))


@R.add("q23_report_pages", duck(f""", {_CHECKED}, rule(result, place, page) AS (VALUES ('SOURCE_FOUND', 1, 'PAGE_FOUND'), ('FORMAT_UNSUPPORTED', 2, 'FORMAT_UNSUPPORTED'), ('NO_CAREER_PAGE', 3, 'NO_CAREER_PAGE'), ('UNREACHABLE', 4, 'UNREACHABLE'), ('USE_FORBIDDEN', 5, 'USE_FORBIDDEN')),
best AS (SELECT company, arg_min(coalesce(page, 'NOT_CHECKED'), coalesce(place, 9)) AS page FROM (SELECT company, unnest(results) AS result FROM picked) u LEFT JOIN rule USING (result) GROUP BY company)
SELECT coalesce(page, 'NO_SITE') AS page, count(*) AS companies FROM benchmark_company l LEFT JOIN best ON company = l.company_id WHERE l.company_id > 0 GROUP BY 1"""))
def report_pages(t):
    return market.report_pages(Domain(t))


@R.add("q23_report_channels", duck(""", kinds AS (SELECT company_id, list(DISTINCT provider) AS providers FROM company_source cs, source s WHERE s.id = source_id GROUP BY 1)
SELECT CASE providers WHEN ['PORTAL'] THEN 'state portal only' ELSE 'own source' END AS channel, count(*) AS companies FROM kinds
WHERE company_id IN (SELECT company_id FROM benchmark_company) AND company_id IN (SELECT company_id FROM company_check WHERE result = 'CONNECTED') GROUP BY 1"""))
def report_channels(t):
    return market.report_channels(Domain(t))


@R.add("q23_report_candidates", duck(""" SELECT proof, check_result, count(*) AS companies FROM (SELECT DISTINCT company_id, proof, coalesce(check_result, 'NOT_CHECKED') AS check_result FROM company_site WHERE status = 'CANDIDATE') x
SEMI JOIN benchmark_company USING (company_id) ANTI JOIN (SELECT company_id FROM company_site WHERE status = 'FOUND') y USING (company_id) GROUP BY ALL"""))
def report_candidates(t):
    return market.report_candidates(Domain(t))


@R.add("q23_report_groups", duck(""", grouped AS (SELECT company_id, source_id FROM company_source SEMI JOIN benchmark_company USING (company_id) WHERE role = 'GROUP'),
busy AS (SELECT DISTINCT source_id FROM job_posting WHERE vacancy_id IN (SELECT id FROM vacancy WHERE list_contains(work_countries, 'SK') OR list_contains(work_countries, '*')))
SELECT (SELECT count(*) FROM (SELECT DISTINCT company_id FROM grouped)) AS companies, (SELECT count(*) FROM (SELECT DISTINCT company_id FROM grouped SEMI JOIN busy USING (source_id))) AS with_vacancies"""))
def report_groups(t):
    return market.report_groups(Domain(t))


# the dictionary


@R.add("q15_dictionary_view", "SELECT s_nationkey AS id, [x FOR x IN list(s_name ORDER BY s_suppkey) FILTER (s_acctbal > 3000) IF x IS NOT NULL] AS titles, count(*) FILTER (s_acctbal <= 3000) AS keywords FROM supplier GROUP BY s_nationkey".replace("[x FOR x IN list(s_name ORDER BY s_suppkey) FILTER (s_acctbal > 3000) IF x IS NOT NULL]", "coalesce(list(s_name ORDER BY s_suppkey) FILTER (s_acctbal > 3000), [])"))
def dictionary(t):
    terms = t("supplier").select(F.col("s_nationkey").alias("position_id"), F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 3000, "TITLE").otherwise("KEYWORD").alias("kind"), F.col("s_name").alias("term"))
    positions = t("supplier").select(F.col("s_nationkey").alias("id")).distinct()
    return market.dictionary_view(positions, terms).select("id", "titles", F.size("keywords").cast("long").alias("keywords"))


@R.add("q15_search_misses", "SELECT query, misses FROM (SELECT lower(trim(event_type)) || ' ' || user_id % 40 AS query, count(*) AS misses, max(ts) AS last_at FROM events GROUP BY 1) ORDER BY misses DESC, last_at DESC, query LIMIT 100")
def misses(t):
    asked = t("events").select(F.concat_ws(" ", F.upper(F.concat(F.lit("  "), "event_type")), (F.col("user_id") % 40).cast("string")).alias("query"), "ts")
    return market.search_misses(asked, "query", "ts").select("query", "misses")


@R.add("q15_chosen_without_vacancies", duck(""", m AS (SELECT DISTINCT code FROM (SELECT p.code, x.vacancy_id FROM vacancy_position_match x JOIN position p ON p.id = x.position_id UNION ALL SELECT j.occupation_code, j.vacancy_id FROM job_posting j) h JOIN vacancy v ON v.id = h.vacancy_id WHERE v.state <> 'CLOSED'),
ch AS (SELECT p.code, count(*) AS conditions FROM condition_position s JOIN position p ON p.id = s.position_id GROUP BY 1 UNION ALL SELECT code, count(*) FROM condition_occupation GROUP BY 1)
SELECT code, conditions FROM ch WHERE code NOT IN (SELECT code FROM m WHERE code IS NOT NULL)"""))
def chosen(t):
    d = Domain(t)
    hits = d["vacancy_position_match"].join(d["position"].select(F.col("id").alias("position_id"), "code"), "position_id").select("code", "vacancy_id").union(d["job_posting"].select("occupation_code", "vacancy_id"))
    return market.chosen_without_vacancies(d, hits)


# pages of results, work queues


@R.add("q02_matched_positions", duck(", m AS (SELECT DISTINCT s.condition_id, x.vacancy_id, p.code FROM condition_position s JOIN position p ON p.id = s.position_id JOIN vacancy_position_match x ON x.position_id = s.position_id) SELECT m.condition_id, m.vacancy_id, list(m.code ORDER BY m.code) AS codes FROM m JOIN delivered d ON d.condition_id = m.condition_id AND d.vacancy_id = m.vacancy_id GROUP BY 1, 2"))
def matched(t):
    d = Domain(t)
    hits = d["condition_position"].join(d["position"].select(F.col("id").alias("position_id"), "code"), "position_id").join(d["vacancy_position_match"], "position_id").select("condition_id", "vacancy_id", "code").distinct()
    return market.matched_positions(hits, d["delivered"])


@R.add("q03_list_by_status", "SELECT o_orderkey AS id, CASE WHEN o_orderpriority < '3' THEN 'APPLIED' ELSE 'VIEWED' END AS status FROM orders WHERE o_custkey % 5 = 2 AND o_orderpriority < '5' AND ('v' || o_orderkey) LIKE '%11%'")
def list_by_status(t):
    o = t("orders")
    name = F.concat(F.lit("V"), F.col("o_orderkey").cast("string"))
    status = F.when(F.col("o_orderpriority") < "3", "APPLIED").when(F.col("o_orderpriority") < "5", "VIEWED").otherwise("NOT_INTERESTED")
    statuses = o.select((F.col("o_custkey") % 5).alias("user_id"), F.col("o_orderkey").alias("vacancy_id"), status.alias("status"), F.col("o_orderdate").alias("changed_at"))
    return market.by_status(o.select(F.col("o_orderkey").alias("id"), name.alias("title")), statuses, 2, ["APPLIED", "VIEWED"], ["v", "11"]).select("id", "status")


_OFFERS = "SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS registration_number, 'Firma ' || o_custkey AS employer FROM orders WHERE o_orderstatus <> 'F'"
_COMPANIES = "SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS registration_number, c_acctbal < 0 AS agency, CASE WHEN c_mktsegment = 'BUILDING' THEN '2024-01-01' END AS terminated_on FROM customer WHERE c_acctbal < 6000"


def _portal(t):
    o, c = t("orders"), t("customer")
    offers = o.where("o_orderstatus <> 'F'").select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("registration_number"), F.concat(F.lit("Firma "), F.col("o_custkey").cast("string")).alias("employer"))
    companies = c.where("c_acctbal < 6000").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("registration_number"), (F.col("c_acctbal") < 0).alias("agency"), F.when(F.col("c_mktsegment") == "BUILDING", "2024-01-01").alias("terminated_on"))
    links = c.where("c_acctbal > 3000").select(F.col("c_custkey").alias("company_id"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("board"))
    return offers, companies, links


@R.add("q22_employers_to_connect", f"SELECT DISTINCT o.registration_number, c.id AS company_id FROM ({_OFFERS}) o JOIN ({_COMPANIES}) c ON c.registration_number IN (o.registration_number, ltrim(o.registration_number, '0')) WHERE c.terminated_on IS NULL AND NOT c.agency AND c.id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)")
def to_connect(t):
    return market.employers_to_connect(*_portal(t))


@R.add("q22_employers_unregistered", f"SELECT o.registration_number AS board, min(o.employer) AS employer FROM ({_OFFERS}) o WHERE NOT EXISTS (SELECT 1 FROM ({_COMPANIES}) c WHERE c.registration_number = ltrim(o.registration_number, '0')) AND o.registration_number NOT IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer WHERE c_acctbal > 8000) GROUP BY 1")
def unregistered(t):
    offers, companies, links = _portal(t)
    some = t("customer").where("c_acctbal > 8000").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("board"))
    return market.employers_without_company(offers, companies, some)


@R.add("q21_board_queue", "SELECT provider, board FROM (SELECT p_brand AS provider, p_name || p_partkey AS board, CASE WHEN p_size > 30 THEN DATE '2024-01-01' + p_size END AS checked_at FROM part) b WHERE (checked_at IS NULL OR checked_at < DATE '2024-02-10') AND board NOT IN (SELECT p_name || p_partkey FROM part WHERE p_retailprice > 1500) ORDER BY checked_at NULLS FIRST, row_number() OVER (PARTITION BY provider ORDER BY checked_at NULLS FIRST, board), provider LIMIT 50")
def boards(t):
    p = t("part")
    board = F.concat("p_name", F.col("p_partkey").cast("string"))
    own = p.select(F.col("p_brand").alias("provider"), board.alias("board"), F.when(F.col("p_size") > 30, F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("timestamp_ntz")).alias("checked_at"))
    return market.boards_to_check(own, p.where("p_retailprice > 1500").select(F.col("p_brand").alias("provider"), board.alias("board")), dt.datetime(2024, 2, 10), 50)


@R.add("q21_site_queue", duck(" SELECT id, company_id FROM (SELECT s.id, s.company_id, s.checked_at, c.id % 3 AS priority, row_number() OVER (PARTITION BY s.company_id ORDER BY s.checked_at NULLS FIRST, s.id) AS r FROM company_site s JOIN company c ON c.id = s.company_id WHERE c.terminated_on IS NULL AND NOT c.not_employer AND s.status IN ('FOUND', 'CANDIDATE') AND (s.checked_at IS NULL OR s.checked_at < TIMESTAMP '2024-01-08 00:00:00')) WHERE r = 1 ORDER BY priority DESC, checked_at NULLS FIRST, id LIMIT 40"))
def site_queue(t):
    d = Domain(t)
    return market.sites_to_check(d["company_site"], d["company"].withColumn("priority", F.col("id") % 3), dt.datetime(2024, 1, 8), 40)


_OUTBOX = "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN ts END AS sent_at FROM events"


@R.add("r09_outbox", f"""WITH o AS ({_OUTBOX}), b AS (SELECT id FROM o WHERE sent_at IS NULL ORDER BY id LIMIT 500)
SELECT o.id, o.sent_at IS NOT NULL OR (b.id IS NOT NULL AND e.value < 90) AS sent, CAST(CASE WHEN b.id IS NOT NULL AND NOT e.value < 90 THEN 1 ELSE 0 END AS BIGINT) AS attempts FROM o JOIN events e ON e.event_id = o.id LEFT JOIN b ON b.id = o.id""")
def r09(t):
    """Two batches: the first has a message without an answer and changes nothing, the second counts."""
    e = t("events")
    outbox = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", F.col("ts")).alias("sent_at"), F.lit(0).cast("long").alias("attempts"))
    batch = queues.outbox_batch(outbox, 500).select("id").join(e, F.col("id") == F.col("event_id"))
    answer = F.when(F.col("value") < 90, "CONFIRMED").otherwise("RETURNED")
    lost = queues.outbox_sent(outbox, batch.select("id", F.when(F.col("value") < 95, answer).alias("answer")), NOW)
    done = queues.outbox_sent(lost, batch.select("id", answer.alias("answer")), NOW)
    return done.select("id", F.col("sent_at").isNotNull().alias("sent"), "attempts")
