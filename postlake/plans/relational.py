"""Demonstration queries: filters, joins, aggregates, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlake.functions.keys import fold
from postlake.functions.scalars import every_word
from postlake.operators import aggregates as agg
from postlake.operators import filters, joins, windows
from postlake.plans.registry import Registry

R = Registry()
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@R.add("f02_array_overlap", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id HAVING list_has_any(list(DISTINCT event_type), ['error', 'signup'])")
def f02(t):
    kinds = t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return kinds.where(F.arrays_overlap("kinds", F.array(F.lit("error"), F.lit("signup"))))


_F03 = """WITH v AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN ['*'] WHEN 3 THEN ['SK', 'CZ'] ELSE ['DE'] END AS c,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'REMOTE' WHEN 2 THEN 'HYBRID' ELSE 'OFFICE' END AS f FROM orders)
SELECT id FROM v WHERE (list_has_any(c, ['SK', 'PL']) OR len(c) = 0) AND (f IS NULL OR f IN ('CONFLICT', 'HYBRID', 'REMOTE'))"""


@R.add("f03_three_valued", _F03)
def f03(t):
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    c = F.when(k % 5 == 1, none).when(k % 5 == 2, F.array(F.lit("*"))).when(k % 5 == 3, F.array(F.lit("SK"), F.lit("CZ"))).when(k % 5 == 4, F.array(F.lit("DE")))
    f = F.when(k % 4 == 1, "REMOTE").when(k % 4 == 2, "HYBRID").when(k % 4 == 3, "OFFICE")
    wanted = F.array(F.lit("SK"), F.lit("PL"))
    return t("orders").where(filters.country_rule(wanted, c) & filters.format_rule(F.lit("REMOTE"), f)).select(k.alias("id"))


@R.add("f05_fresh", "SELECT count(*) AS n FROM orders WHERE o_orderdate IS NULL OR o_orderdate > TIMESTAMP '1998-06-30' - INTERVAL 4 MONTHS")
def f05(t):
    return t("orders").where(filters.fresh(F.col("o_orderdate"), F.lit("1998-06-30").cast("date"))).agg(F.count("*").alias("n"))


@R.add("f07_every_word", "SELECT doc_id FROM documents WHERE contains(translate(lower(text), 'áäčďéíĺľňóôöŕšťúüýž', 'aacdeillnooorstuuyz'), 'des') AND contains(translate(lower(text), 'áäčďéíĺľňóôöŕšťúüýž', 'aacdeillnooorstuuyz'), 'eaur')")
def f07(t):
    return t("documents").where(every_word(F.col("text"), ["dés", "EAUR"], fold)).select("doc_id")


@R.add("f08_null_safe", "SELECT count(*) FILTER (nullif(l_returnflag, 'N') IS DISTINCT FROM nullif(l_linestatus, 'O')) AS differ, count(*) FILTER (nullif(l_returnflag, 'N') IS NOT DISTINCT FROM nullif(l_linestatus, 'O')) AS same FROM lineitem")
def f08(t):
    same = F.nullif("l_returnflag", F.lit("N")).eqNullSafe(F.nullif("l_linestatus", F.lit("O")))
    return t("lineitem").agg(F.count_if(~same).alias("differ"), F.count_if(same).alias("same"))


_RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END"


@R.add("f10_rank_decode", f"SELECT o_custkey, CASE min({_RANK}) WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' ELSE 'NONE' END AS best FROM orders GROUP BY o_custkey")
def f10(t):
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    return t("orders").groupBy("o_custkey").agg(F.min(filters.ranked(F.col("o_orderpriority"), order)).alias("r")).select("o_custkey", filters.unranked(F.col("r"), order).alias("best"))


@R.add("f11_regex", r"SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)^https?://(www|m)\.')")
def f11(t):
    return t("pages").where(F.col("url").rlike(r"(?i)^https?://(www|m)\.")).select("page_id")


@R.add("f12_affixes", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') OR ends_with(p_type, 'STEEL') OR contains(p_name, '7')")
def f12(t):
    return t("part").where(F.startswith("p_brand", F.lit("Brand#1")) | F.endswith("p_type", F.lit("STEEL")) | F.contains("p_name", F.lit("7"))).select("p_partkey")


@R.add("f13_gap", "SELECT DISTINCT user_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts >= TIMESTAMP '2024-01-10')")
def f13(t):
    e = t("events")
    bought = e.where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))).select("user_id")
    return e.where("event_type = 'click'").select("user_id").distinct().join(bought, "user_id", "left_anti")


@R.add("f14_exists_or", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def f14(t):
    big = t("orders").where("o_totalprice > 200000")
    return joins.flagged(t("customer"), "c_custkey", big, "o_custkey", "big").where("c_acctbal < 0 OR big").select("c_custkey")


@R.add("f15_first_name", "SELECT n_regionkey, arg_min(n_name, n_name) AS name, count(*) AS n FROM nation GROUP BY n_regionkey")
def f15(t):
    first = joins.first_by(t("nation").withColumn("name", F.col("n_name")), ["n_regionkey"], [F.col("n_name")], ["name"])
    return first.join(t("nation").groupBy("n_regionkey").agg(F.count("*").alias("n")), "n_regionkey")


@R.add("j03_left_on_predicate", "SELECT p_brand, count(DISTINCT p_partkey) AS parts, count(l_orderkey) AS big_lines FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 45 GROUP BY p_brand")
def j03(t):
    p, x = t("part"), t("lineitem")
    return p.join(x, (x["l_partkey"] == p["p_partkey"]) & (x["l_quantity"] >= 45), "left").groupBy("p_brand").agg(F.count_distinct("p_partkey").alias("parts"), F.count("l_orderkey").alias("big_lines"))


@R.add("j04_semi_customers_with_orders", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j04(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@R.add("j05_anti_customers_without_orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j05(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@R.add("j06_null_aware_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def j06(t):
    return joins.not_in(t("part"), "p_partkey", t("lineitem").where("l_quantity > 48"), "l_partkey").select("p_partkey")


@R.add("j07_self_pairs_same_key", "SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def j07(t):
    return joins.ordered_pairs(t("supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], "s_suppkey")


@R.add("j08_self_pairs_residual", "SELECT DISTINCT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE a.p_type = b.p_type OR abs(a.p_retailprice - b.p_retailprice) < 5")
def j08(t):
    near = lambda x, y: (F.col(f"{x}.p_type") == F.col(f"{y}.p_type")) | (F.abs(F.col(f"{x}.p_retailprice") - F.col(f"{y}.p_retailprice")) < 5)
    return joins.ordered_pairs(t("part").select("p_partkey", "p_brand", "p_size", "p_type", "p_retailprice"), ["p_brand", "p_size"], "p_partkey", near)


@R.add("j10_least_greatest_pairs", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def j10(t):
    return t("lineitem").where("l_partkey <> l_suppkey").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.count("*").alias("n"))


@R.add("j11_join_on_expression", "SELECT p.page_id, d.doc_id FROM pages p JOIN documents d ON 'p:' || p.page_id = 'p:' || d.doc_id")
def j11(t):
    p, d = t("pages").withColumn("k", F.concat(F.lit("p:"), "page_id")), t("documents").withColumn("k", F.concat(F.lit("p:"), "doc_id"))
    return p.join(d, "k").select("page_id", "doc_id")


@R.add("j13_dictionary_regex_join", r"SELECT d.doc_id, w.code FROM documents d JOIN (VALUES ('D', 'der'), ('T', 'the'), ('L', 'les'), ('Q', 'que')) w(code, term) ON regexp_matches(lower(d.text), '(^|[^a-z])' || w.term || '([^a-z]|$)')")
def j13(t):
    codes = {"D": "der", "T": "the", "L": "les", "Q": "que"}
    hit = F.array_compact(F.array(*[F.when(F.lower("text").rlike(f"(^|[^a-z]){w}([^a-z]|$)"), F.lit(c)) for c, w in codes.items()]))
    return t("documents").select("doc_id", F.explode(hit).alias("code"))


@R.add("j15_unpivot_stack", "SELECT c_nationkey, m.metric, m.value FROM (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS neg FROM customer GROUP BY 1) c, LATERAL (VALUES ('known', c.n), ('negative', c.neg), ('rest', c.n - c.neg)) m(metric, value)")
def j15(t):
    c = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("known"), F.count_if(F.col("c_acctbal") < 0).alias("negative")).withColumn("rest", F.col("known") - F.col("negative"))
    return c.unpivot(["c_nationkey"], ["known", "negative", "rest"], "metric", "value")


@R.add("j16_explode_outer", "SELECT d.doc_id, w.word FROM (SELECT doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 9)) AS ws FROM documents) d LEFT JOIN LATERAL (SELECT unnest(d.ws) AS word) w ON TRUE")
def j16(t):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 9))
    return t("documents").select("doc_id", F.explode_outer(words).alias("word"))


@R.add("j18_only_match", "SELECT c_nationkey, min(c_mktsegment) AS c_mktsegment FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) = 1")
def j18(t):
    return joins.only_match(t("customer").where("c_acctbal > 9000"), "c_nationkey", "c_mktsegment")


@R.add("j09_either_key", "SELECT DISTINCT key FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN '00' ELSE '' END || o_custkey AS key FROM orders) WHERE key IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 5000) OR ltrim(key, '0') IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 5000)")
def j09(t):
    keys = t("orders").select(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "00").otherwise(""), "o_custkey").alias("key")).distinct()
    return joins.either_key(keys, "key", t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("k")), "k")


_J20 = """SELECT DISTINCT c, k FROM (SELECT o_custkey AS c, l_partkey AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49
UNION ALL SELECT o_custkey, p_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 50
UNION ALL SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE s_acctbal > 9000 AND c_acctbal > 9000)"""


@R.add("j20_union_paths_match", _J20)
def j20(t):
    lines = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c"), "l_partkey", "l_quantity")
    paths = joins.matched_by_paths([
        lines.where("l_quantity > 49").select("c", F.col("l_partkey").alias("k")),
        lines.join(t("part").where("p_size = 50"), F.col("p_partkey") == F.col("l_partkey")).select("c", F.col("p_partkey").alias("k")),
    ])
    customers = t("customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("nation"))
    suppliers = t("supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return joins.matched_by_key(paths, customers, suppliers, "nation")


@R.add("g01_grouping_sets_total", "SELECT c_nationkey, CASE WHEN grouping(c_mktsegment) = 1 THEN '' ELSE coalesce(c_mktsegment, 'NONE') END AS c_mktsegment, count(DISTINCT c_custkey) AS value FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_nationkey, c_mktsegment))")
def g01(t):
    return agg.with_total(t("customer"), "c_nationkey", "c_mktsegment", F.count_distinct("c_custkey"))


@R.add("g02_grouping_sets_grand", "SELECT CASE WHEN grouping(event_type) = 1 THEN '' ELSE event_type END AS kind, count(*) AS value FROM events GROUP BY GROUPING SETS ((), (event_type))")
def g02(t):
    e = t("events")
    g = e.groupingSets([[], ["event_type"]], "event_type").agg(F.count("*").alias("value"), F.grouping("event_type").alias("g"))
    return g.select(F.when(F.col("g") == 1, "").otherwise(F.col("event_type")).alias("kind"), "value")


@R.add("g04_count_filter", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS big, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS top_urgent, bool_or(o_totalprice > 400000) AS any_huge, bool_and(o_totalprice > 0) AS all_paid FROM orders GROUP BY o_orderstatus")
def g04(t):
    return t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("big"), F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("top_urgent"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_huge"), F.bool_and(F.col("o_totalprice") > 0).alias("all_paid"))


@R.add("g05_distinct_filter_anti", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(DISTINCT c_custkey) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without FROM customer GROUP BY c_mktsegment")
def g05(t):
    c = joins.flagged(t("customer"), "c_custkey", t("orders"), "o_custkey", "has")
    return c.groupBy("c_mktsegment").agg(F.count_distinct("c_custkey").alias("customers"), F.count_distinct(F.when(~F.col("has"), F.col("c_custkey"))).alias("without"))


@R.add("g09_joined_texts", "SELECT conv_id, string_agg(coalesce(role, ''), ' ' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def g09(t):
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role")))), lambda s: s["role"]), " ").alias("roles"), F.count("*").alias("n"))


@R.add("g11_ordered_array_slice", "SELECT p_brand, (list(p_name ORDER BY p_partkey))[1:5] AS p_name FROM part GROUP BY p_brand")
def g11(t):
    return agg.first_values(t("part"), "p_brand", "p_name", "p_partkey", 5)


@R.add("g12_distinct_array", "SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment) FILTER (c_mktsegment IS NOT NULL)) AS segments FROM customer GROUP BY c_nationkey")
def g12(t):
    return t("customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))


@R.add("g13_json_agg", """SELECT n_regionkey, '[' || string_agg('{"k":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS rows FROM nation GROUP BY n_regionkey""")
def g13(t):
    return t("nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))))).alias("rows"))


@R.add("g15_majority_share", "SELECT source, lang, n, total FROM (SELECT source, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY source)::BIGINT AS total FROM documents GROUP BY source, lang) WHERE n >= 0.5 * total AND total >= 2")
def g15(t):
    return agg.majority(t("documents").select("source", "lang"), "source", "lang", share=0.5)


@R.add("g16_unambiguous", "SELECT p_size, min(p_brand) AS p_brand FROM part WHERE p_retailprice > 1900 GROUP BY p_size HAVING count(DISTINCT p_brand) = 1")
def g16(t):
    return agg.unambiguous(t("part").where("p_retailprice > 1900"), "p_size", "p_brand")


_G17 = """WITH one AS (SELECT DISTINCT l_returnflag AS k, l_suppkey AS voter, l_linestatus AS c FROM lineitem)
SELECT o.k, o.c, count(*) AS n, any_value(t.total) AS total FROM one o JOIN (SELECT k, count(DISTINCT voter) AS total FROM one GROUP BY k) t USING (k) GROUP BY o.k, o.c"""


@R.add("g17_votes", _G17)
def g17(t):
    return agg.votes(t("lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_suppkey").alias("voter"), F.col("l_linestatus").alias("c")), "k", "voter", "c")


@R.add("g18_facets_zero_fill", "SELECT n_nationkey, n_name, count(c_custkey) AS total FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9500) ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def g18(t):
    rich = t("customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("n_nationkey"))
    return agg.facets(t("nation").select("n_nationkey", "n_name"), rich, "n_nationkey")


@R.add("g19_mostly_not", "SELECT user_id, count(*) FILTER (event_type = 'click') AS hits, count(*) AS n FROM events GROUP BY user_id HAVING 2 * count(*) FILTER (event_type = 'click') < count(*)")
def g19(t):
    return agg.mostly_not(t("events"), "user_id", F.col("event_type") == "click")


@R.add("g21_scalar_totals", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done, (SELECT max(l_quantity) FROM lineitem) AS top")
def g21(t):
    return t("orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done")).crossJoin(F.broadcast(t("lineitem").agg(F.max("l_quantity").alias("top"))))


@R.add("g22_pivot", "SELECT event_type, count(*) FILTER (day(ts) <= 10) AS d1, count(*) FILTER (day(ts) BETWEEN 11 AND 20) AS d2, count(*) FILTER (day(ts) > 20) AS d3 FROM events GROUP BY event_type")
def g22(t):
    part = F.when(F.dayofmonth("ts") <= 10, "d1").when(F.dayofmonth("ts") <= 20, "d2").otherwise("d3")
    return t("events").withColumn("part", part).groupBy("event_type").pivot("part", ["d1", "d2", "d3"]).agg(F.count(F.lit(1))).na.fill(0)


@R.add("w01_partition_count_order", "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders ORDER BY size DESC, o_orderkey LIMIT 50")
def w01(t):
    return windows.page(windows.with_size(t("orders").select("o_orderkey", "o_custkey"), "o_custkey"), [F.desc("size"), F.asc("o_orderkey")], 0, 50)


@R.add("w02_page_with_total", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def w02(t):
    o = t("orders")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey").crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))


@R.add("w03_fair_pick", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def w03(t):
    return windows.latest(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@R.add("w04_round_robin", "SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier ORDER BY turn, s_nationkey LIMIT 40")
def w04(t):
    q = windows.fair_queue(t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", [F.desc("s_acctbal"), F.asc("s_suppkey")])
    return windows.page(q, [F.asc("turn"), F.asc("s_nationkey")], 0, 40).select("s_suppkey", "s_nationkey", F.col("turn").cast("long").alias("turn"))


@R.add("w05_window_over_aggregate", "SELECT lang, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang)::BIGINT AS total FROM documents GROUP BY lang, source")
def w05(t):
    n = t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("lang")))


@R.add("w06_distinct_on_latest", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def w06(t):
    return windows.latest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@R.add("w07_best_status", "SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def w07(t):
    return windows.latest(t("orders"), ["o_custkey"], [filters.ranked(F.col("o_orderstatus"), ["F", "O"]).asc(), F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


@R.add("t01_page_offset", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def t01(t):
    return windows.page(t("orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 40, 20)


@R.add("t02_boolean_keys", "SELECT c_custkey FROM customer ORDER BY (c_mktsegment = 'BUILDING') DESC, (c_acctbal < 0), c_custkey LIMIT 30")
def t02(t):
    return windows.page(t("customer"), [(F.col("c_mktsegment") == "BUILDING").desc(), (F.col("c_acctbal") < 0).asc(), F.asc("c_custkey")], 0, 30).select("c_custkey")


@R.add("t03_nulls_first_queue", "SELECT c_custkey, last FROM (SELECT c_custkey, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) ORDER BY last ASC NULLS FIRST, c_custkey LIMIT 25")
def t03(t):
    last = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.max("o_orderdate").alias("last"))
    return windows.page(last, [F.asc_nulls_first("last"), F.asc("c_custkey")], 0, 25)


@R.add("t06_top_k_per_key", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def t06(t):
    r = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return t("lineitem").withColumn("r", r).where("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@R.add("u02_union_distinct", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def u02(t):
    return t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).union(t("supplier").where("s_acctbal > 9000").select("s_nationkey")).distinct()


_U03 = "SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey"


@R.add("u03_symmetric_pairs", _U03)
def u03(t):
    p = joins.ordered_pairs(t("supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], "s_suppkey")
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return p.select(F.explode(both).alias("p")).select("p.a", "p.b")


@R.add("u04_except_keys", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_returnflag = 'R')")
def u04(t):
    return t("part").select("p_partkey").join(t("lineitem").where("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")
