"""Spark's side of queries whose SQL is in more.py, by the functions that a user of the library calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.operators import filters, joins, merges, windows
from postlake.plans import market
from postlake.plans.domain import Domain
from postlake.plans.registry import Registry

R = Registry()
C = F.col


@R.add("f06_optional_filters")
def f06(t):
    return t("orders").where(filters.optional(C("o_orderstatus"), None) & filters.optional(C("o_orderpriority"), "1-URGENT")).select("o_orderkey")


@R.add("f16_country_filter")
def f16(t):
    here = t("nation").where("n_regionkey = 3").select(C("n_nationkey").alias("s_nationkey"))
    return t("supplier").join(here, "s_nationkey", "left_semi").select("s_suppkey")


@R.add("j01_inner")
def j01(t):
    return t("customer").join(t("orders").where("o_totalprice > 100000"), C("o_custkey") == C("c_custkey")).select("c_custkey", "o_orderkey")


@R.add("j02_left")
def j02(t):
    return joins.counted(t("nation"), "n_nationkey", t("supplier"), "s_nationkey", "suppliers").groupBy("n_name").agg(F.sum("suppliers").alias("suppliers"))


@R.add("j12_parameters")
def j12(t):
    return joins.with_parameters(t("orders"), floor=150000.0).where("o_totalprice > floor").select("o_orderkey")


@R.add("j17_employers_of_posting")
def j17(t):
    d = Domain(t)
    return market.employers_of_postings(d["job_posting"], d["company_source"], d["offer_position"].select("num", (1 + C("num") % 100).alias("company_id"))).withColumnRenamed("company_id", "company")


@R.add("g03_count_distinct")
def g03(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@R.add("g06_max_filter")
def g06(t):
    return t("orders").groupBy("o_custkey").agg(F.max(F.when(C("o_orderstatus") == "F", C("o_orderkey"))).alias("last_done"))


@R.add("g07_min_max_sum")
def g07(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count("*").alias("n"), F.sum(C("l_quantity").cast("long")).alias("q"))


@R.add("g08_bool_aggregates")
def g08(t):
    return t("orders").groupBy("o_custkey").agg(F.bool_or(C("o_totalprice") > 300000).alias("any_big"), F.bool_and(C("o_orderstatus") == "F").alias("all_done"))


@R.add("g14_having")
def g14(t):
    return t("lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n")).where("n >= 2")


@R.add("g20_distinct")
def g20(t):
    return t("documents").select("lang", "source").distinct()


@R.add("w08_count_over_partition")
def w08(t):
    return windows.with_size(t("supplier"), "s_nationkey", "near").select("s_suppkey", "near")


@R.add("t04_top_one")
def t04(t):
    return windows.page(t("orders"), [F.desc("o_totalprice"), C("o_orderkey")], 0, 1).select("o_orderkey")


@R.add("t07_capped_batch")
def t07(t):
    return windows.page(t("orders"), [C("o_orderkey")], 0, 200).select("o_orderkey")


@R.add("x25_url_templates")
def x25(t):
    tails = F.explode(F.array(*map(F.lit, ("/kariera", "/career", "/jobs"))))
    return t("pages").select("page_id", "url", tails.alias("tail")).select("page_id", "tail", F.concat("url", "tail").alias("address"))


@R.add("x26_empty_is_null")
def x26(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("named", F.nullif("source", F.lit("src0")))


@R.add("d01_interval_arithmetic")
def d01(t):
    return t("events").select("event_id", (C("ts") + F.make_dt_interval(mins=F.lit(90))).alias("later"), (C("ts") - F.make_dt_interval(days=F.lit(7))).alias("before"))


@R.add("d02_next_hour")
def d02(t):
    hour = F.date_trunc("hour", C("ts")).cast("timestamp_ntz")
    return t("events").select("event_id", (hour + F.make_dt_interval(hours=F.lit(1))).alias("run"))


@R.add("m01_least_greatest")
def m01(t):
    quantity, tax = F.nullif("l_quantity", F.lit(1.0)), C("l_tax") * 100
    return t("lineitem").select("l_orderkey", "l_linenumber", F.least(quantity, tax).alias("low"), F.greatest(quantity, tax).alias("high"))


@R.add("a01_unnest")
def a01(t):
    return Domain(t)["vacancy"].select("id", F.explode("work_countries").alias("country"))


@R.add("a03_cardinality")
def a03(t):
    known = C("work_countries").isNotNull()
    return Domain(t)["vacancy"].select("id", F.when(known, F.size("work_countries").cast("long")).alias("n"), F.array_contains("work_countries", "SK").alias("sk"))


@R.add("a04_filter_prefix")
def a04(t):
    return Domain(t)["vacancy"].select("id", F.filter("work_countries", lambda x: F.startswith(x, F.lit("S"))).alias("s"))


@R.add("n03_json_defaults")
def n03(t):
    return t("events").select("event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("x"))


@R.add("p09_stale_versions")
def p09(t):
    seen = F.when(C("id") % 3 == 0, "d1").when(C("id") % 3 == 1, "d2")
    return market.stale(Domain(t)["vacancy"].where("state <> 'CLOSED'").withColumn("version", seen), "version", "d2").select("id")


@R.add("b13_dedupe_boards")
def b13(t):
    return merges.dedupe(t("part").select(F.lower("p_brand").alias("board"), "p_partkey"), ["board"], "p_partkey")


@R.add("b16_versioned_condition")
def b16(t):
    return windows.versions(t("nation").select(C("n_nationkey").alias("id"), C("n_regionkey").alias("user_id")), "user_id", "id")


@R.add("b17_version_bump")
def b17(t):
    d = Domain(t)
    current = d["position"].where("id < 3").agg(F.concat(F.lit("d"), F.count("*").cast("string")).alias("current"))
    own = d["vacancy"].withColumn("version", F.concat(F.lit("d"), (1 + C("id") % 2).cast("string")))
    return own.crossJoin(F.broadcast(current)).where("version <> current").agg(F.count("*").alias("stale"))  # one row


@R.add("b19_site_review")
def b19(t):
    kept = Domain(t)["company_site"].where("proof <> 'Brand#11'")
    return windows.with_size(kept, "company_id", "n").select("company_id", "id", F.when(C("n") == 1, "FOUND").otherwise("CANDIDATE").alias("status"))


@R.add("q04_details_accessible")
def q04(t):
    return market.accessible(Domain(t), 2).select("id", "title", "status")


@R.add("q25_country_turns")
def q25(t):
    own = windows.fair_queue(t("nation"), "n_regionkey", [C("n_nationkey")], "turn")
    return own.where("turn <= 2").select("n_nationkey", C("turn").cast("long").alias("turn"))


@R.add("q26_pending_requests")
def q26(t):
    d = Domain(t)
    return d["company"].where("agency").join(d["task"].where("state = 'FAILED'").select("id"), "id", "left_anti").select("id")


@R.add("q29_offers_per_employer")
def q29(t):
    offers = lambda test: t("orders").where(test).select(C("o_custkey").alias("employer"), "o_orderkey")
    return offers("o_totalprice > 100000 OR o_orderpriority < '3'").groupBy("employer").agg(F.count("*").alias("n"))


# queries of their own


@R.add("q13_company_search_by_number", """WITH c AS (SELECT c_custkey AS id, c_name AS name, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS number FROM customer)
SELECT id, name, n.grp AS in_group, n.result, n.site FROM c LEFT JOIN (SELECT c_custkey, c_nationkey < 5 AS grp, CASE WHEN c_acctbal > 0 THEN 'CONNECTED' END AS result, CASE WHEN c_acctbal > 5000 THEN 'https://w' || c_custkey || '.sk' END AS site FROM customer) n ON n.c_custkey = c.id
WHERE number = '00000012' OR name LIKE '%Customer#00000001%'""")
def company_search(t):
    c = t("customer")
    companies = c.select(C("c_custkey").alias("id"), C("c_name").alias("name"), F.lpad(C("c_custkey").cast("string"), 8, "0").alias("registration_number"))
    sources = c.where("c_nationkey < 5").select(C("c_custkey").alias("company_id"), F.lit("GROUP").alias("role"))
    checks = c.where("c_acctbal > 0").select(C("c_custkey").alias("company_id"), F.lit("CONNECTED").alias("result"))
    sites = c.where("c_acctbal > 5000").select(C("c_custkey").alias("company_id"), F.concat(F.lit("https://w"), C("c_custkey").cast("string"), F.lit(".sk")).alias("url"), C("c_custkey").alias("id"))
    both = [market.company_search(companies, sources, checks, sites, said) for said in ("12", "Customer#00000001")]
    return both[0].union(both[1]).distinct().select("id", "name", "in_group", "result", "site")
