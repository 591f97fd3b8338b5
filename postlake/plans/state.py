"""Demonstration queries: merges, lifecycle, resolution, and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlake.functions import keys
from postlake.operators import lifecycle, merges, resolve
from postlake.plans.registry import Registry
from postlake.streaming import twins

R = Registry()

_OLD = "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_acctbal AS bal FROM customer WHERE c_acctbal > 500"
_NEW = "SELECT c_custkey AS k, 'new ' || c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(c_mktsegment) END AS seg, c_acctbal + 1 AS bal FROM customer WHERE c_mktsegment <> 'BUILDING'"


def _sides(t):
    k = F.col("c_custkey")
    old = t("customer").where("c_acctbal > 500").select(k.alias("k"), F.col("c_name").alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("seg"), F.col("c_acctbal").alias("bal"))
    new = t("customer").where("c_mktsegment <> 'BUILDING'").select(k.alias("k"), F.concat(F.lit("new "), "c_name").alias("name"), F.when(k % 5 != 0, F.lower("c_mktsegment")).alias("seg"), (F.col("c_acctbal") + 1).alias("bal"))
    return old, new


@R.add("b01_insert_absent", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)")
def b01(t):
    return merges.insert_absent(*_sides(t), ["k"])


@R.add("b02_upsert_coalesce", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, coalesce(n.seg, o.seg) AS seg, coalesce(n.bal, o.bal) AS bal FROM o FULL JOIN n ON o.k = n.k")
def b02(t):
    return merges.upsert(*_sides(t), ["k"])


@R.add("b03_conditional_upsert", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.k, n.k) AS k, coalesce(o.name, n.name) AS name, CASE WHEN n.k IS NOT NULL AND (o.k IS NULL OR o.bal < 5000) THEN coalesce(n.seg, o.seg) ELSE o.seg END AS seg, CASE WHEN n.k IS NOT NULL AND (o.k IS NULL OR o.bal < 5000) THEN coalesce(n.bal, o.bal) ELSE o.bal END AS bal FROM o FULL JOIN n ON o.k = n.k")
def b03(t):
    return merges.upsert(*_sides(t), ["k"], when=F.col("o.bal") < 5000, keep=("name",))


@R.add("b04_update_from", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT o.k, o.name, CASE WHEN n.k IS NOT NULL THEN n.seg ELSE o.seg END AS seg, CASE WHEN n.k IS NOT NULL THEN n.bal ELSE o.bal END AS bal FROM o LEFT JOIN n ON o.k = n.k")
def b04(t):
    return merges.update_from(*_sides(t), ["k"], ["seg", "bal"])


@R.add("b05_checked_update", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT o.k, CASE WHEN n.seg IS NOT DISTINCT FROM o.seg AND n.k IS NOT NULL THEN n.name ELSE o.name END AS name, o.seg, o.bal FROM o LEFT JOIN n ON o.k = n.k")
def b05(t):
    old, new = _sides(t)
    return merges.checked_update(old, new, ["k"], "seg", ["name"])[0]


@R.add("b06_collapse_min", """WITH moves AS (SELECT o_custkey AS merged, min(o_custkey) OVER (PARTITION BY o_custkey // 10) AS kept FROM (SELECT DISTINCT o_custkey FROM orders)),
x AS (SELECT coalesce(m.kept, o.o_custkey) AS o_custkey, o_orderpriority, o_orderdate, o_orderkey FROM orders o LEFT JOIN moves m ON m.merged = o.o_custkey AND m.kept <> m.merged)
SELECT o_custkey, o_orderpriority, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM x) WHERE r = 1""")
def b06(t):
    c = t("orders").select(F.col("o_custkey").alias("merged")).distinct().withColumn("kept", F.min("merged").over(Window.partitionBy(F.floor(F.col("merged") / 10))))
    return merges.collapse(t("orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey"), c.where("kept <> merged"), "o_custkey", ["o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderdate", "o_orderkey"])


_KNOWN = "SELECT o_custkey % 3 AS source_id, 'x' || o_orderkey AS external_id, o_orderkey % 4 AS missing, CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '2024-01-01' END AS closed_at FROM orders WHERE o_orderstatus <> 'P'"
_FETCHED = "SELECT o_custkey % 3 AS source_id, 'x' || o_orderkey AS external_id, CASE WHEN o_orderkey % 11 = 0 THEN 'ftp://x' ELSE 'https://h/x' END AS url FROM orders WHERE o_totalprice > 100000"
_B08 = f"""WITH k AS ({_KNOWN}), f AS ({_FETCHED}), r AS (SELECT * FROM (VALUES (0, true, false), (1, false, false), (2, false, true)) v(source_id, complete, unrec)),
x AS (SELECT coalesce(k.source_id, f.source_id) AS source_id, coalesce(k.external_id, f.external_id) AS external_id, k.external_id IS NOT NULL AS old, f.external_id IS NOT NULL AND starts_with(f.url, 'https') AS seen, f.external_id IS NULL AS unlisted, k.missing, k.closed_at
  FROM k FULL JOIN f ON k.source_id = f.source_id AND k.external_id = f.external_id),
y AS (SELECT x.*, r.complete, old AND NOT seen AND unlisted AND (r.complete OR r.unrec) AS counts, CASE WHEN r.complete THEN 3 ELSE 5 END AS lim FROM x JOIN r ON r.source_id = x.source_id WHERE old OR seen)
SELECT source_id, event, count(*) AS n, sum(missing)::BIGINT AS missing FROM (SELECT source_id, CASE WHEN NOT old THEN 'INSERTED' WHEN seen AND complete AND closed_at IS NOT NULL THEN 'REOPENED' WHEN seen AND complete THEN 'CONFIRMED'
  WHEN counts AND coalesce(missing, 0) + 1 >= lim AND closed_at IS NULL THEN 'CLOSED' WHEN counts THEN 'MISSING' ELSE 'UNCONFIRMED' END AS event,
  CASE WHEN seen AND complete THEN 0 WHEN counts THEN coalesce(missing, 0) + 1 ELSE coalesce(missing, 0) END AS missing FROM y) GROUP BY source_id, event"""


@R.add("b08_posting_merge", _B08)
def b08(t):
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    x = t("orders").withColumns({"source_id": F.col("o_custkey") % 3, "external_id": F.concat(F.lit("x"), "o_orderkey"), "location": none, "content": none})
    known = x.where("o_orderstatus <> 'P'").select("source_id", "external_id", F.lit("t").alias("title"), F.lit("https://h/x").alias("url"), "location", "content", F.lit(True).alias("confirmed"), (k % 4).alias("missing"), F.when(k % 7 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("closed_at"))
    fetched = x.where("o_totalprice > 100000").select("source_id", "external_id", F.lit("n").alias("title"), F.when(k % 11 == 0, "ftp://x").otherwise("https://h/x").alias("url"), "location", "content")
    run = known.select("source_id").distinct().select("source_id", (F.col("source_id") == 0).alias("complete"), (F.col("source_id") == 2).alias("unrecognised"), F.lit("2024-02-01").cast("timestamp_ntz").alias("read_at"))
    return lifecycle.posting_merge(known, fetched, run).groupBy("source_id", "event").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"))


@R.add("b12_vacancy_state", "SELECT o_custkey AS vacancy_id, CASE WHEN NOT bool_or(o_orderstatus <> 'F') THEN 'CLOSED' WHEN bool_or(o_orderstatus = 'O') THEN 'ACTIVE' ELSE 'NEEDS_RECHECK' END AS state FROM orders GROUP BY o_custkey")
def b12(t):
    p = t("orders").select(F.col("o_custkey").alias("vacancy_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("closed_at"), (F.col("o_orderstatus") == "O").alias("confirmed"))
    return lifecycle.vacancy_state(p)


@R.add("b14_incremental_append", "SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM orders d JOIN lineitem e ON e.l_orderkey = d.o_orderkey WHERE d.o_orderdate < TIMESTAMP '1997-01-01' AND d.o_custkey = orders.o_custkey AND e.l_partkey = lineitem.l_partkey)")
def b14(t):
    day = F.lit("1997-01-01").cast("timestamp_ntz")
    x = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey", "o_orderdate")
    return merges.append_new(x.where(F.col("o_orderdate") < day).drop("o_orderdate"), x.where(F.col("o_orderdate") >= day).drop("o_orderdate"), ["o_custkey", "l_partkey"])


@R.add("b15_visit_boundary", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 30 MINUTE THEN ts ELSE TIMESTAMP '2024-01-01' END AS boundary FROM events")
def b15(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return t("events").select("event_id", merges.visit(F.col("ts"), at("2024-01-01"), at("2024-01-20 12:00:00")).alias("boundary"))


@R.add("b18_response_groups", "SELECT o_orderkey, CASE WHEN s = 'REJECTED' OR c OR (s = 'APPLIED' AND d >= 42) THEN 'FINISHED' WHEN s = 'APPLIED' AND d >= 21 THEN 'SILENT' ELSE 'ACTIVE' END AS grp FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'APPLIED' WHEN 1 THEN 'INTERVIEW' ELSE 'REJECTED' END AS s, o_orderstatus = 'P' AS c, o_orderkey % 60 AS d FROM orders)")
def b18(t):
    k = F.col("o_orderkey")
    s = F.when(k % 3 == 0, "APPLIED").when(k % 3 == 1, "INTERVIEW").otherwise("REJECTED")
    return t("orders").select("o_orderkey", lifecycle.response_group(s, F.col("o_orderstatus") == "P", k % 60).alias("grp"))


#: The graph of _copies in SQL, and its components.
_EDGES = """k AS (SELECT doc_id, unnest(['t:' || sha256(text), 'k:' || lower(split_part(text, chr(10), 1))]) AS key FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT a, doc_id AS b FROM k JOIN (SELECT key, min(doc_id) AS a FROM k GROUP BY key) f USING (key) WHERE a <> doc_id)"""
_J21 = f"""WITH RECURSIVE {_EDGES}, u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
c AS (SELECT x AS node, x AS label FROM u UNION SELECT c.node, u.y FROM c JOIN u ON u.x = c.label)
SELECT node, min(label) AS label FROM c GROUP BY node"""
_Q18 = f"""WITH {_EDGES}, p AS (SELECT a, b, 1 + (a + b) % 6 AS rank FROM e UNION SELECT b, a, 1 + (a + b) % 6 FROM e),
best AS (SELECT a AS merged, b AS kept, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b, rank) AS r FROM p WHERE b < a) WHERE r = 1)
SELECT * FROM best WHERE merged NOT IN (SELECT kept FROM best)"""


def _copies(t):
    """Pairs (a, b) of all documents: each with the first one of the same text, and of the same first line but for case."""
    own = t("documents").select("doc_id", F.explode(F.array(F.concat(F.lit("t:"), F.sha2("text", 256)), F.concat(F.lit("k:"), F.lower(F.split_part("text", F.lit("\n"), F.lit(1)))))).alias("key")).where("key IS NOT NULL")
    first = own.groupBy("key").agg(F.min("doc_id").alias("a"))
    return own.join(first, "key").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


@R.add("j21_min_label_components", _J21)
def j21(t):
    return resolve.components(_copies(t))


@R.add("q18_merge_batch", _Q18)
def q18(t):
    return resolve.keepers(_copies(t).withColumn("rank", 1 + (F.col("a") + F.col("b")) % 6))


@R.add("q18_resolve_all", f"SELECT node AS merged, label AS kept FROM ({_J21}) WHERE node <> label")
def q18_all(t):
    return resolve.resolve_all(_copies(t).withColumn("rank", F.lit(1))).select("merged", "kept")


@R.add("x_same_employer_keys", "SELECT count(*) AS n, count(DISTINCT lower(c_name)) AS names FROM customer")
def x_same(t):
    return t("customer").agg(F.count("*").alias("n"), F.count_distinct(keys.fold(F.col("c_name"))).alias("names"))


@R.add("r01_hour_windows", "SELECT date_trunc('hour', ts)::TIMESTAMP AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def r01(t):
    return twins.hour_windows(t("events"))


_R02 = """WITH m AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS begin, count(*) AS n FROM s GROUP BY user_id, k"""


@R.add("r02_sessions_30m", _R02)
def r02(t):
    return twins.sessions(t("events"))


_R03 = """WITH e AS (SELECT user_id, event_id, ts, event_type = 'click' AS seen FROM events),
g AS (SELECT *, count(*) FILTER (seen) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e),
c AS (SELECT user_id, event_id, seen, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) - CASE WHEN k > 0 THEN 1 ELSE 0 END AS missing FROM g)
SELECT user_id, count(*) FILTER (NOT seen AND missing = 3) AS closings FROM c GROUP BY user_id"""


@R.add("r03_absence_counter", _R03)
def r03(t):
    return twins.absences(t("events").select("user_id", "event_id", "ts", (F.col("event_type") == "click").alias("seen")))


_R11 = """WITH RECURSIVE e AS (SELECT user_id AS host, event_id, epoch_us(ts) AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
c AS (SELECT host, event_id, r, 0::BIGINT AS w, asked + 3600000000 AS free FROM e WHERE r = 1
  UNION ALL SELECT e.host, e.event_id, e.r, greatest(c.free - e.asked, 0)::BIGINT, CASE WHEN c.free - e.asked <= 7200000000 THEN greatest(c.free, e.asked) + 3600000000 ELSE c.free END FROM c JOIN e ON e.host = c.host AND e.r = c.r + 1)
SELECT host, event_id, w <= 7200000000 AS granted, CASE WHEN w <= 7200000000 THEN w END AS wait FROM c"""


@R.add("r11_rate_limiter", _R11)
def r11(t):
    return twins.rate_limited(t("events").select(F.col("user_id").alias("host"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), interval=3_600_000_000, most=7_200_000_000)


_R13 = """WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT *, lag(n) OVER w AS before, lag(n, 2) OVER w AS before2 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, coalesce(before >= 5 AND n * 2 < before, false) AS dropped FROM g"""


@R.add("r13_drop_guard", _R13)
def r13(t):
    d = t("events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))
    return d.withColumn("b", before).select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.coalesce(lifecycle.dropped(F.col("b"), F.col("n")), F.lit(False)).alias("dropped"))
