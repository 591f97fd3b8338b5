"""The domain's named plans, over tables of vacancies, postings, companies and conditions.

Each takes a dict of DataFrames by table name (columns as in schemas.py) and `now` or a day, so
results don't depend on the clock. Shared frames (matches, placed) are written once as views of
the plan; Spark reuses their exchanges.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.keys import fold, same_title
from postlake.operators.aggregates import facets, with_total
from postlake.operators.filters import format_rule, fresh, ranked, unranked
from postlake.operators.joins import dealt_join, first_by, flagged, sized

Tables = dict[str, DataFrame]
#: Feeds that are no source of a company's own.
PORTALS = ("PORTAL", "PROFESIA")
#: Results of a site check from best to worst, and the channel that each stands for.
SITE_RESULTS = ["SOURCE_FOUND", "FORMAT_UNSUPPORTED", "PORTAL_ONLY", "NO_CAREER_PAGE", "UNREACHABLE", "USE_FORBIDDEN"]
CHANNELS = ["PAGE_FOUND", "FORMAT_UNSUPPORTED", "NO_OWN_PAGE", "NO_CAREER_PAGE", "UNREACHABLE", "USE_FORBIDDEN"]
LOSSES = ("NO_SITE", "NO_CAREER_PAGE", "UNREACHABLE", "USE_FORBIDDEN")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def at(value: dt.datetime | dt.date) -> Column:
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, dt.datetime) else F.lit(value)


#: Postings whose matches one task finds.
TASK_POSTINGS = 250_000


def _matches(t: Tables, within: DataFrame | None = None) -> DataFrame:
    """(condition_id, code, vacancy_id), distinct: chosen positions, portal codes of chosen groups, positions of the
    groups, recognised codes, and mapped positions of portal offers; of the vacancies (vacancy_id) of `within` alone, if named.

    What vacancies show is dealt by vacancy to tasks of bounded size and distinct there, before conditions multiply it."""
    groups, posting, match = t["condition_occupation"].select("condition_id", "code"), t["job_posting"], t["vacancy_position_match"].select("vacancy_id", "position_id")
    position = t["position"].select(F.col("id").alias("position_id"), F.col("code").alias("position_code"), "occupation_code")
    group, one = (lambda c: F.concat(F.lit("group "), c)), F.concat(F.lit("position "), F.col("position_id").cast("string"))
    shown = [
        match.select("vacancy_id", one.alias("key")),
        match.join(position, "position_id").select("vacancy_id", group("occupation_code").alias("key")),
        posting.select("vacancy_id", F.explode(F.array(group("occupation_code"), group("title_occupation_code"))).alias("key")),
    ]
    if "offer_position" in t:
        offers = t["offer_position"].select(F.concat(F.lit("profesia:"), "num").alias("external_id"), group("code").alias("key")).where("key IS NOT NULL")
        shown.append(posting.select("external_id", "vacancy_id").join(offers.join(groups.select(group("code").alias("key")), "key", "left_semi"), "external_id").select("vacancy_id", "key"))
    chosen = t["condition_position"].join(position, "position_id").select("condition_id", F.col("position_code").alias("code"), one.alias("key"))
    wanted = groups.withColumn("key", group("code")).unionByName(chosen).distinct()
    own = _union(shown).where("key IS NOT NULL").repartition(posting.count() // TASK_POSTINGS + 1, "vacancy_id")
    own = own if within is None else own.join(within, "vacancy_id", "left_semi")
    return own.distinct().join(sized(wanted), "key").select("condition_id", "code", "vacancy_id").distinct()


def search_matches(t: Tables, now: dt.datetime) -> DataFrame:
    """(condition_id, code, vacancy_id), distinct, without vacancies that their employer posted more
    than four months ago."""
    open_ = t["vacancy"].where(fresh(F.col("posted_at"), at(now))).select(F.col("id").alias("vacancy_id"))
    return _matches(t, open_)


def _fitting(t: Tables, now: dt.datetime, hide_after_days: int) -> DataFrame:
    """(condition, vacancy) pairs that fit by position, place, format, freshness and state."""
    hits = _matches(t).select("condition_id", "vacancy_id").distinct()
    c = t["condition"].select(F.col("id").alias("condition_id"), "user_id", F.col("countries").alias("wanted"), F.col("work_format").alias("wanted_format"))
    v = t["vacancy"].where((F.col("state") != "CLOSED") & (F.col("last_confirmed_at") >= at(now - dt.timedelta(days=hide_after_days))) & fresh(F.col("posted_at"), at(now))).withColumnRenamed("id", "vacancy_id")
    fits = (F.arrays_overlap("wanted", "work_countries") | (F.cardinality("work_countries") == 0)) & format_rule(F.col("wanted_format"), F.col("work_format"))
    return hits.join(c, "condition_id").join(v, "vacancy_id").where(fits)


def deliver_portion(t: Tables, now: dt.datetime, hide_after_days: int = 30) -> DataFrame:
    """(condition_id, vacancy_id) to deliver: what fits, the user has not answered, and the condition
    has not had. Idempotent: what was delivered is taken out by an anti join."""
    answered = t["user_status"].where("status <> 'VIEWED'").select("user_id", "vacancy_id")
    out = _fitting(t, now, hide_after_days).join(answered, ["user_id", "vacancy_id"], "left_anti")
    return out.join(t["delivered"], ["condition_id", "vacancy_id"], "left_anti").select("condition_id", "vacancy_id", "first_seen_at")


def visible(t: Tables, now: dt.datetime, hide_after_days: int = 30) -> DataFrame:
    """Delivered vacancies of each condition that still fit and are new or viewed, with the user's status."""
    st = t["user_status"].select("user_id", "vacancy_id", F.col("status").alias("user_status"))
    own = _fitting(t, now, hide_after_days).join(t["delivered"].select("condition_id", "vacancy_id"), ["condition_id", "vacancy_id"], "left_semi")
    return own.join(st, ["user_id", "vacancy_id"], "left").where("user_status IS NULL OR user_status = 'VIEWED'").withColumn("opened", F.coalesce("posted_at", "first_seen_at"))


def result_counts(rows: DataFrame) -> DataFrame:
    """(condition_id, total, new)."""
    return rows.groupBy("condition_id").agg(F.count("*").alias("total"), F.count_if(F.col("user_status").isNull()).alias("new"))


def result_page(rows: DataFrame, condition: int, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of one condition's results, latest first."""
    return rows.where(F.col("condition_id") == condition).orderBy(F.desc("opened"), F.desc("vacancy_id")).offset(offset).limit(limit)


def search(rows: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """Rows in whose joined columns every word occurs, without case and marks."""
    text = fold(F.concat_ws(" ", *columns))
    return rows.where(reduce(lambda a, w: a & F.contains(text, fold(F.lit(w))), words, F.lit(True)))


def facet_counts(t: Tables, rows: DataFrame, now: dt.datetime) -> DataFrame:
    """(code, total) of visible vacancies per position code, 0 where there are none."""
    hits = search_matches(t, now).join(rows.select("condition_id", "vacancy_id"), ["condition_id", "vacancy_id"], "left_semi").select("code")
    return facets(t["position"].select("code").distinct(), hits, "code")


def _placed_sources(t: Tables) -> DataFrame:
    """Open sources with their own country, else the smallest of their companies, else ''."""
    links = t["company_source"].where(F.col("role").isin("EMPLOYER", "GROUP")).join(t["company"].select(F.col("id").alias("company_id"), F.col("country").alias("of")), "company_id")
    first = links.groupBy(F.col("source_id").alias("id")).agg(F.min("of").alias("of"))
    return t["source"].where("closed_at IS NULL").join(first, "id", "left").withColumn("country", F.coalesce("country", "of", F.lit(""))).drop("of")


def daily_metrics(t: Tables, day: dt.date, begin: dt.datetime, end: dt.datetime) -> DataFrame:
    """(day, country, metric, dimension, value) of a day between two instants."""
    rows: list[DataFrame] = []

    def emit(df: DataFrame, metric: str | None = None) -> None:
        df = df.withColumn("metric", F.lit(metric)) if metric else df
        df = df if "dimension" in df.columns else df.withColumn("dimension", F.lit(""))
        rows.append(df.select("country", "metric", "dimension", F.col("value").cast("long").alias("value")))

    known = t["company"].where((F.col("first_seen_at") < at(end)) & (F.col("terminated_on").isNull() | (F.col("terminated_on") > at(day)))).select(F.col("id").alias("company_id"), "country")
    checks = t["company_check"].where(F.col("first_checked_at") < at(end)).select("company_id", "result")
    both = known.join(checks, "company_id", "left").groupBy("country").agg(F.count("*").alias("companies_known"), F.count("result").alias("companies_processed"))
    emit(both.withColumn("companies_remaining", F.col("companies_known") - F.col("companies_processed")).unpivot(["country"], ["companies_known", "companies_processed", "companies_remaining"], "metric", "value"))
    processed = known.join(checks, "company_id")
    sites = t["company_site"].where((F.col("status") == "FOUND") & (F.col("found_at") < at(end))).select("company_id", F.col("proof").alias("dimension"))
    emit(with_total(processed.join(sites, "company_id"), "country", "dimension", F.count_distinct("company_id")), "companies_with_site")
    links = t["company_source"].where(F.col("role").isin("EMPLOYER", "GROUP")).join(t["source"].select(F.col("id").alias("source_id"), F.col("provider").alias("dimension")), "source_id").select("company_id", "dimension")
    emit(with_total(processed.where("result = 'CONNECTED'").join(links, "company_id", "left"), "country", "dimension", F.count_distinct("company_id")), "companies_connected")
    emit(with_total(processed.where("result <> 'CONNECTED'").withColumnRenamed("result", "dimension"), "country", "dimension", F.count("*")), "companies_failed")
    placed = t["vacancy"].select("id", "state", "first_seen_at", "closed_at", F.explode_outer(F.array_distinct("work_countries")).alias("country")).withColumn("country", F.coalesce("country", F.lit("")))
    known_ids = t["vacancy_position_match"].select("vacancy_id").union(t["job_posting"].where("occupation_code IS NOT NULL OR title_occupation_code IS NOT NULL").select("vacancy_id"))
    placed = flagged(placed, "id", known_ids, "vacancy_id", "recognised")
    day_of = lambda c: (F.col(c) >= at(begin)) & (F.col(c) < at(end))
    kinds = F.array_compact(F.array(
        F.when(F.col("state") == "ACTIVE", "vacancies_active").when(F.col("state") != "CLOSED", "vacancies_recheck"),
        F.when((F.col("state") != "CLOSED") & F.col("recognised"), "vacancies_recognized"),
        F.when(day_of("first_seen_at"), "vacancies_new"),
        F.when(day_of("closed_at"), "vacancies_closed"),
    ))
    emit(placed.select("country", F.explode(kinds).alias("metric")).groupBy("country", "metric").agg(F.count("*").alias("value")))
    sources = _placed_sources(t)
    emit(with_total(sources.withColumnRenamed("availability", "dimension"), "country", "dimension", F.count("*")), "sources")
    runs = t["crawl_run"].where(day_of("finished_at"))
    outcome = F.when(F.col("state") == "COMPLETE", "COMPLETE").when(F.col("state") == "PARTIAL", F.concat(F.lit("PARTIAL:"), "reason")).otherwise(F.concat(F.lit("FAILED:"), "reason"))
    last = runs.groupBy("source_id").agg(F.max_by(outcome, F.struct("finished_at", "id")).alias("dimension"))
    emit(with_total(last.join(sources.select(F.col("id").alias("source_id"), "country"), "source_id"), "country", "dimension", F.count("*")), "source_reads")
    window = end - dt.timedelta(hours=24)
    read = t["crawl_run"].where((F.col("started_at") >= at(window)) & (F.col("started_at") < at(end))).select(F.col("source_id").alias("id"))
    due = sources.where((F.col("availability") != "UNAVAILABLE") & ~F.col("provider").isin(*PORTALS) & (F.col("created_at") < at(window)))
    emit(due.join(read, "id", "left_anti").groupBy("country").agg(F.count("*").alias("value")), "sources_overdue")
    failed = t["task"].where((F.col("state") == "FAILED") & day_of("updated_at")).select(F.lit("").alias("country"), F.col("type").alias("dimension"))
    grouped = failed.groupingSets([["country"], ["country", "dimension"]], "country", "dimension").agg(F.count("*").alias("value"), F.grouping("dimension").alias("g"))
    emit(grouped.withColumn("dimension", F.when(F.col("g") == 1, "").otherwise(F.col("dimension"))).drop("g"), "operations_failed")
    return _union(rows).select(F.lit(str(day)).alias("day"), "*")


def coverage(t: Tables) -> DataFrame:
    """(company_id, portal_titles, found_on_own, own_vacancies, channel) of employers with open portal vacancies."""
    company = t["company"].where("terminated_on IS NULL AND NOT agency AND NOT not_employer").select(F.col("id").alias("company_id"), "country", "no_own_career_page")
    open_source = t["source"].where("closed_at IS NULL").select(F.col("id").alias("source_id"), F.col("provider").isin(*PORTALS).alias("portal"))
    link = t["company_source"].join(open_source, "source_id")
    vacancy = t["vacancy"].where("state <> 'CLOSED'").select(F.col("id").alias("vacancy_id"), "work_countries")
    posting = t["job_posting"].where("closed_at IS NULL").select("source_id", "vacancy_id", same_title(F.col("title")).alias("title_key"))
    own_country = F.coalesce(F.array_contains("work_countries", F.col("country")), F.lit(False)) | (F.coalesce(F.cardinality("work_countries"), F.lit(0)) == 0)
    employer = company.join(link.where("role = 'EMPLOYER'"), "company_id").select("company_id", "country", "source_id", "portal")
    p, tasks, dealt = dealt_join(employer, posting.join(vacancy, "vacancy_id"), "source_id", "vacancy_id")
    p = p.where(own_country)
    # per title: is it on the portal, is it on an own source; first of a source, where its rows are, then of the company
    sides = [F.bool_or("on_portal").alias("on_portal"), F.bool_or("on_own").alias("on_own")]
    near = p.withColumns({"on_portal": F.col("portal"), "on_own": ~F.col("portal")}).groupBy(*dealt, "company_id", "title_key").agg(*sides)
    titles = near.select("company_id", "title_key", "on_portal", "on_own").repartition(tasks, "company_id", "title_key").groupBy("company_id", "title_key").agg(*sides)
    counted = titles.where("on_portal").groupBy("company_id").agg(F.count("*").alias("portal_titles"), F.count_if("on_own").alias("found_on_own"))
    own = p.where(~F.col("portal")).select("company_id", "vacancy_id").repartition(tasks, "company_id", "vacancy_id").distinct().groupBy("company_id").agg(F.count("*").alias("own_vacancies"))
    has = link.groupBy("company_id").agg(F.bool_or((F.col("role") == "EMPLOYER") & ~F.col("portal")).alias("own_source"), F.bool_or(F.col("role") == "GROUP").alias("group_source"))
    best = t["company_site"].where("status = 'FOUND'").groupBy("company_id").agg(F.min(ranked(F.col("check_result"), SITE_RESULTS)).alias("rank"))
    out = counted.join(company, "company_id").join(own, "company_id", "left").join(has, "company_id", "left").join(best, "company_id", "left")
    out = out.withColumn("own_vacancies", F.coalesce("own_vacancies", F.lit(0)))
    channel = (
        F.when(F.col("no_own_career_page"), "NO_OWN_PAGE")
        .when(F.col("own_source"), F.when(F.col("own_vacancies") > 0, "READ").otherwise("READ_EMPTY"))
        .when(F.col("group_source"), "GROUP_ONLY")
        .when(F.col("rank").isNull(), "NO_SITE")
        .otherwise(unranked(F.col("rank"), CHANNELS, "NOT_CHECKED"))
    )
    return out.select("company_id", "country", "portal_titles", "found_on_own", "own_vacancies", channel.alias("channel"))


def coverage_metrics(rows: DataFrame) -> DataFrame:
    """(country, metric, dimension, value) of coverage by channel and in total."""
    own = rows.where("channel <> 'NO_OWN_PAGE'").withColumn("coverage_companies", F.lit(1).cast("long"))
    long = own.withColumnsRenamed({"portal_titles": "coverage_portal_vacancies", "found_on_own": "coverage_found_on_own"}).unpivot(["country", "channel"], ["coverage_companies", "coverage_portal_vacancies", "coverage_found_on_own"], "metric", "v")
    sets = [["country", "metric"], ["country", "metric", "channel"]]
    grouped = long.groupingSets(sets, "country", "metric", "channel").agg(F.sum("v").alias("value"), F.grouping("channel").alias("g"))
    return grouped.select("country", "metric", F.when(F.col("g") == 1, "").otherwise(F.col("channel")).alias("dimension"), "value")


def loss_queue(t: Tables, rows: DataFrame, now: dt.datetime) -> DataFrame:
    """Companies that lose vacancies for want of a page, most lost first (column lost)."""
    unchecked = t["company_site"].where("status = 'FOUND' AND checked_at IS NULL").select("company_id")
    blocked = t["company"].where(F.col("no_own_career_page") | F.col("not_employer") | F.col("terminated_on").isNotNull() | (F.col("loss_postponed_until") > at(now))).select(F.col("id").alias("company_id"))
    out = rows.where(F.col("channel").isin(*LOSSES) & (F.col("found_on_own") < F.col("portal_titles")))
    out = out.join(unchecked, "company_id", "left_anti").join(blocked, "company_id", "left_anti")
    return out.withColumn("lost", F.col("portal_titles") - F.col("found_on_own"))


def missing_titles(t: Tables) -> DataFrame:
    """(company_id, title_key, title): open portal titles that none of the company's own sources has."""
    link = t["company_source"].where("role = 'EMPLOYER'").join(t["source"].where("closed_at IS NULL").select(F.col("id").alias("source_id"), F.col("provider").isin(*PORTALS).alias("portal")), "source_id")
    p = link.join(t["job_posting"].where("closed_at IS NULL").select("source_id", "title", same_title(F.col("title")).alias("title_key")), "source_id")
    per = p.groupBy("company_id", "title_key").agg(F.bool_or(~F.col("portal")).alias("own"), F.bool_or("portal").alias("any"), F.min(F.when(F.col("portal"), F.col("title"))).alias("title"))
    return per.where("any AND NOT own").select("company_id", "title_key", "title")


def report_checks(t: Tables) -> DataFrame:
    """(result, companies) of the benchmark companies, NOT_CHECKED where there is no check."""
    b = t["benchmark_company"].where("company_id IS NOT NULL")
    return b.join(t["company_check"].select("company_id", "result"), "company_id", "left").groupBy(F.coalesce("result", F.lit("NOT_CHECKED")).alias("result")).agg(F.count("*").alias("companies"))


def _benchmark(t: Tables) -> DataFrame:
    return t["benchmark_company"].where("company_id IS NOT NULL").select("company_id")


def report_registry(t: Tables) -> DataFrame:
    """One row: benchmark companies in the registry, those of them that have ended, those not in it."""
    c = t["company"].select(F.col("id").alias("company_id"), "terminated_on")
    return t["benchmark_company"].join(c, "company_id", "left").agg(F.count("company_id").alias("in_registry"), F.count("terminated_on").alias("terminated"), F.count_if(F.col("company_id").isNull()).alias("not_in_registry"))


def report_sites(t: Tables) -> DataFrame:
    """One row: benchmark companies with a found site, and all of them."""
    found = t["company_site"].where("status = 'FOUND'").select("company_id").distinct().withColumn("found", F.lit(True))
    return _benchmark(t).join(found, "company_id", "left").agg(F.count("found").alias("site_found"), F.count("*").alias("in_registry"))


def checked_sites(t: Tables) -> DataFrame:
    """Found sites that are checked: of those known from the crawl index alone only a company's first."""
    found = t["company_site"].where("status = 'FOUND'")
    crawled = F.col("source") == "COMMON_CRAWL"
    per = found.groupBy("company_id").agg(F.bool_and(crawled).alias("only_crawled"), F.min("id").alias("lowest"))
    return found.join(per, "company_id").where(~crawled | (F.col("only_crawled") & (F.col("id") == F.col("lowest")))).drop("only_crawled", "lowest")


def report_pages(t: Tables) -> DataFrame:
    """(page, companies): the best result of a company's checked sites, NO_SITE without any."""
    order = [r for r in SITE_RESULTS if r != "PORTAL_ONLY"]  # a site with the portal alone counts as not checked
    best = checked_sites(t).groupBy("company_id").agg(F.min(ranked(F.col("check_result"), order)).alias("best"))
    b = _benchmark(t).join(best, "company_id", "left")
    page = F.when(F.col("best").isNull(), "NO_SITE").otherwise(unranked(F.col("best"), ["PAGE_FOUND", *order[1:]], "NOT_CHECKED"))
    return b.groupBy(page.alias("page")).agg(F.count("*").alias("companies"))


def report_channels(t: Tables) -> DataFrame:
    """(channel, companies) of connected benchmark companies: the state portal alone, or an own source."""
    connected = _benchmark(t).join(t["company_check"].where("result = 'CONNECTED'").select("company_id"), "company_id")
    own = connected.join(t["company_source"], "company_id").join(t["source"].select(F.col("id").alias("source_id"), "provider"), "source_id")
    per = own.groupBy("company_id").agg(F.bool_and(F.col("provider") == "PORTAL").alias("only"))
    return per.groupBy(F.when(F.col("only"), "state portal only").otherwise("own source").alias("channel")).agg(F.count("*").alias("companies"))


def report_candidates(t: Tables) -> DataFrame:
    """(proof, check_result, companies): candidates of benchmark companies without a found site."""
    s = t["company_site"]
    open_ = _benchmark(t).join(s.where("status = 'FOUND'").select("company_id"), "company_id", "left_anti")
    own = open_.join(s.where("status = 'CANDIDATE'"), "company_id")
    return own.groupBy("proof", F.coalesce("check_result", F.lit("NOT_CHECKED")).alias("check_result")).agg(F.count_distinct("company_id").alias("companies"))


def report_groups(t: Tables, countries: tuple[str, ...] = ("SK", "*")) -> DataFrame:
    """One row: benchmark companies with a source of their group, and those whose group has vacancies there."""
    here = t["vacancy"].where(F.arrays_overlap("work_countries", F.array(*map(F.lit, countries)))).select(F.col("id").alias("vacancy_id"))
    sources = t["job_posting"].join(here, "vacancy_id").select("source_id").distinct().withColumn("has", F.lit(True))
    own = _benchmark(t).join(t["company_source"].where("role = 'GROUP'"), "company_id").join(sources, "source_id", "left")
    return own.agg(F.count_distinct("company_id").alias("companies"), F.count_distinct(F.when(F.col("has"), F.col("company_id"))).alias("with_vacancies"))


def dictionary_view(positions: DataFrame, terms: DataFrame) -> DataFrame:
    """positions (id, ...) with the terms of each kind, in order of their ids; a position without terms has none."""
    kinds = {"TITLE": "titles", "ROLE": "roles", "KEYWORD": "keywords", "EXCLUDE": "excluded"}
    own = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("id", "term")))), lambda x: x["term"])
    per = terms.groupBy("position_id").agg(*[own(k).alias(n) for k, n in kinds.items()])
    out = positions.join(per, positions["id"] == per["position_id"], "left").drop("position_id")
    return out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in kinds.values()})


def search_misses(asked: DataFrame, query: str, time: str, most: int = 100) -> DataFrame:
    """(query, misses, last_at) of searches without a result, the most frequent first, then the latest."""
    key = F.lower(F.trim(F.regexp_replace(query, r"\s+", " ")))
    return asked.groupBy(key.alias("query")).agg(F.count("*").alias("misses"), F.max(time).alias("last_at")).orderBy(F.desc("misses"), F.desc("last_at"), "query").limit(most)


def chosen_without_vacancies(t: Tables, hits: DataFrame) -> DataFrame:
    """(code, conditions) of the positions and groups that conditions name and no open vacancy matches;
    hits has (code, vacancy_id)."""
    positions = t["condition_position"].join(t["position"].select(F.col("id").alias("position_id"), "code"), "position_id").select("code")
    chosen = _union([x.groupBy("code").agg(F.count("*").alias("conditions")) for x in (positions, t["condition_occupation"].select("code"))])
    open_ = t["vacancy"].where("state <> 'CLOSED'").select(F.col("id").alias("vacancy_id"))
    return chosen.join(hits.join(open_, "vacancy_id", "left_semi").select("code").distinct(), "code", "left_anti")


def employers(t: Tables) -> DataFrame:
    """(vacancy_id, employer): the name to show, of a company before that of a group, smallest id first."""
    c = t["company"].select(F.col("id").alias("company_id"), "name")
    rows = t["job_posting"].select("vacancy_id", "source_id").join(t["company_source"].where(F.col("role").isin("EMPLOYER", "GROUP")), "source_id").join(c, "company_id")
    return first_by(rows.withColumnRenamed("name", "employer"), ["vacancy_id"], [F.col("role") == "GROUP", F.col("company_id")], ["employer"])


def employers_of_postings(postings: DataFrame, company_sources: DataFrame, offers: DataFrame) -> DataFrame:
    """(id, company_id) of postings: the employers of its source, and that of the portal's offer (num,
    company_id) it comes from."""
    own = postings.join(company_sources.where("role = 'EMPLOYER'"), "source_id").select("id", "company_id")
    named = offers.select(F.concat(F.lit("profesia:"), F.col("num").cast("string")).alias("external_id"), "company_id")
    return own.union(postings.join(named, "external_id").select("id", "company_id")).distinct()


def stale(rows: DataFrame, version: str, current: str) -> DataFrame:
    """Rows that were computed with another version, or never."""
    return rows.where(~F.col(version).eqNullSafe(F.lit(current)))


def accessible(t: Tables, user: int) -> DataFrame:
    """Vacancies with the user's status that the user may open: those with one, and those delivered to one
    of the user's conditions."""
    own = t["user_status"].where(F.col("user_id") == user).select(F.col("vacancy_id").alias("id"), "status")
    mine = t["condition"].where(F.col("user_id") == user).select(F.col("id").alias("condition_id"))
    sent = t["delivered"].join(mine, "condition_id", "left_semi").select(F.col("vacancy_id").alias("id")).distinct().withColumn("sent", F.lit(True))
    return t["vacancy"].join(own, "id", "left").join(sent, "id", "left").where("status IS NOT NULL OR sent").drop("sent")


def details(t: Tables, user: int, languages: DataFrame) -> DataFrame:
    """Of each vacancy that the user may open its columns, the user's status, and languages (vacancy_id, language, required)
    as an array in order, empty where there are none; a language said twice is required if it is once."""
    said = languages.where("language IS NOT NULL").groupBy("vacancy_id", "language").agg(F.bool_or("required").alias("required"))
    per = said.groupBy(F.col("vacancy_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("language", "required"))).alias("languages"))
    none = F.array().cast("array<struct<language:string,required:boolean>>")
    return accessible(t, user).join(per, "id", "left").withColumn("languages", F.coalesce("languages", none))


def company_search(companies: DataFrame, sources: DataFrame, checks: DataFrame, sites: DataFrame, said: str) -> DataFrame:
    """companies (id, name, registration_number) found by number, if said is one, else by a part of their
    name's slug; with in_group, the result of their check, and their first site."""
    from postlake.functions.keys import name_slug

    number = said.strip().replace(" ", "")
    slug = F.nullif(name_slug(F.lit(said)), F.lit(""))
    found = companies.where(F.col("registration_number") == number.zfill(8)) if number.isdigit() else companies.where(F.contains(name_slug(F.col("name")), slug))
    group = sources.where("role = 'GROUP'").select(F.col("company_id").alias("id")).distinct().withColumn("in_group", F.lit(True))
    site = sites.groupBy(F.col("company_id").alias("id")).agg(F.min_by("url", "id").alias("site"))
    out = found.join(group, "id", "left").join(checks.select(F.col("company_id").alias("id"), "result"), "id", "left").join(site, "id", "left")
    return out.withColumn("in_group", F.coalesce("in_group", F.lit(False)))


def matched_positions(hits: DataFrame, page: DataFrame) -> DataFrame:
    """(condition_id, vacancy_id, codes): for the rows of a result page the codes by which they match, in order."""
    own = hits.join(page.select("condition_id", "vacancy_id"), ["condition_id", "vacancy_id"], "left_semi")
    return own.groupBy("condition_id", "vacancy_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def by_status(vacancies: DataFrame, statuses: DataFrame, user: int, wanted: list[str], words: list[str] = ()) -> DataFrame:
    """vacancies (id, title, ...) that have one of these statuses of a user, with status and changed_at,
    the latest change first; every word must stand in the title."""
    own = statuses.where((F.col("user_id") == user) & F.col("status").isin(*wanted)).select(F.col("vacancy_id").alias("id"), "status", "changed_at")
    return search(vacancies.join(own, "id"), ["title"], list(words)).orderBy(F.desc("changed_at"), F.desc("id"))


def employers_to_connect(offers: DataFrame, companies: DataFrame, links: DataFrame) -> DataFrame:
    """(registration_number, company_id) of employers of current portal offers whose company is known,
    alive and no agency, and has no portal source of that number; links has (company_id, board). Offers may
    write a number with leading zeros that the company's has not."""
    own = companies.where("terminated_on IS NULL AND NOT agency").select(F.col("id").alias("company_id"), F.col("registration_number").alias("own"))
    number = F.col("registration_number")
    asked = offers.select(number).where(number.isNotNull()).distinct().withColumn("own", F.explode(F.array_distinct(F.array(number, F.ltrim(number, F.lit("0"))))))
    found = asked.join(own, "own").select("registration_number", "company_id").distinct()
    return found.join(links.select("company_id", F.col("board").alias("registration_number")), ["registration_number", "company_id"], "left_anti")


def employers_without_company(offers: DataFrame, companies: DataFrame, boards: DataFrame) -> DataFrame:
    """(board, employer): employers of current portal offers that no company has the number of, and that
    have no source; the board is the number, or the slug of the name where there is none."""
    from postlake.functions.keys import name_slug

    known = companies.select(F.col("registration_number").alias("own")).distinct()
    number = F.col("registration_number")
    own = offers.join(known, number == F.col("own"), "left_anti").join(known, F.ltrim(number, F.lit("0")) == F.col("own"), "left_anti")
    named = own.select(F.coalesce(number, F.concat(F.lit("name:"), name_slug(F.col("employer")))).alias("board"), "employer")
    return named.join(boards.select("board"), "board", "left_anti").groupBy("board").agg(F.min("employer").alias("employer"))


def boards_to_check(boards: DataFrame, sources: DataFrame, before: dt.datetime, limit: int) -> DataFrame:
    """(provider, board) of discovered boards (provider, board, checked_at) that are no source yet and were
    not checked since: never checked ones first, providers in turn."""
    due = boards.where(F.col("checked_at").isNull() | (F.col("checked_at") < at(before))).join(sources, ["provider", "board"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("provider").orderBy(F.asc_nulls_first("checked_at"), "board"))
    return due.withColumn("turn", turn).orderBy(F.asc_nulls_first("checked_at"), "turn", "provider").limit(limit).select("provider", "board")


def sites_to_check(sites: DataFrame, companies: DataFrame, before: dt.datetime, limit: int) -> DataFrame:
    """The next site of each company (id, company_id) that is alive and an employer, of those found or
    candidates and not checked since; important companies first, then the longest unchecked."""
    alive = companies.where("terminated_on IS NULL AND NOT not_employer").select(F.col("id").alias("company_id"), "priority")
    due = sites.where(F.col("status").isin("FOUND", "CANDIDATE") & (F.col("checked_at").isNull() | (F.col("checked_at") < at(before)))).join(alive, "company_id")
    first = F.row_number().over(Window.partitionBy("company_id").orderBy(F.asc_nulls_first("checked_at"), "id"))
    return due.withColumn("turn", first).where("turn = 1").orderBy(F.desc("priority"), F.asc_nulls_first("checked_at"), "id").limit(limit).select("id", "company_id")


def sizes_to_check(companies: DataFrame, countries: DataFrame, country: str, before: dt.datetime, limit: int) -> DataFrame:
    """(id, registration_number) of the country's companies that haven't ended and whose size was not looked up since;
    important ones first, then the longest ago, never before all. No rows unless the country (country, active) is collected."""
    own = companies.where((F.col("country") == country) & F.col("terminated_on").isNull()).join(_collected(countries), "country", "left_semi")
    due = own.where(F.col("employees_checked_at").isNull() | (F.col("employees_checked_at") < at(before)))
    return due.orderBy(F.desc("priority"), F.asc_nulls_first("employees_checked_at"), "id").limit(limit).select("id", "registration_number")


def _collected(countries: DataFrame) -> DataFrame:
    return countries.where("active").select("country")


def _portal_companies(employers: DataFrame, companies: DataFrame, countries: DataFrame, country: str, checked: str, before: dt.datetime) -> DataFrame:
    """Portal employers not checked since, with the companies that have their number, with or without leading zeros:
    an equi join on either spelling."""
    due = employers.where(F.col(checked).isNull() | (F.col(checked) < at(before))).withColumnRenamed("registration_number", "number")
    spelt = due.withColumn("spelling", F.explode(F.array_distinct(F.array("number", F.ltrim("number", F.lit("0"))))))
    own = companies.where((F.col("country") == country) & F.col("terminated_on").isNull()).join(_collected(countries), "country", "left_semi")
    own = own.select(F.col("id").alias("company_id"), "name", "priority", F.col("registration_number").alias("spelling"))
    return spelt.join(own, "spelling")


def employers_for_sites(employers: DataFrame, companies: DataFrame, countries: DataFrame, country: str, before: dt.datetime, limit: int) -> DataFrame:
    """(number, company_id, name): portal employers (registration_number, site_checked_at) whose site is due to be looked
    for; important ones first, then the longest ago."""
    due = _portal_companies(employers, companies, countries, country, "site_checked_at", before)
    return due.orderBy(F.desc("priority"), F.asc_nulls_first("site_checked_at"), "number", "company_id").limit(limit).select("number", "company_id", "name")


def employers_for_offers(employers: DataFrame, companies: DataFrame, countries: DataFrame, sources: DataFrame, postings: DataFrame, provider: str, country: str, before: dt.datetime, limit: int) -> DataFrame:
    """(number, company_id, url): portal employers (registration_number, profesia_checked_at) with an open offer of the ad
    portal among the postings of their own board, and the address of the one confirmed last (ties: smallest address).

    Of an employer's postings one is kept before any join, so a board with very many sends one row a task."""
    due = _portal_companies(employers, companies, countries, country, "profesia_checked_at", before)
    live = postings.where(F.col("closed_at").isNull() & F.col("external_id").startswith("profesia:"))
    last = live.groupBy("source_id").agg(F.min(F.struct((-F.unix_micros(F.col("last_confirmed_at").cast("timestamp"))).alias("age"), "url")).alias("last"))
    boards = sources.where(F.col("provider") == provider).select(F.col("id").alias("source_id"), F.col("board").alias("number"))
    hits = due.join(boards, "number").join(last, "source_id")
    one = hits.groupBy("number", "profesia_checked_at").agg(F.min(F.struct("last.age", "last.url", "company_id", "priority")).alias("top"))
    return one.orderBy(F.desc("top.priority"), F.asc_nulls_first("profesia_checked_at"), "number").limit(limit).select("number", "top.company_id", "top.url")


def learn_heads(postings: DataFrame, share: float = 0.7, least: int = 2) -> DataFrame:
    """(head, code, n, total): title heads whose portal codes agree by majority."""
    from postlake.functions.keys import title_head
    from postlake.operators.aggregates import majority

    heads = postings.where("occupation_code IS NOT NULL").select(title_head(F.col("title")).alias("head"), F.col("occupation_code").alias("code"))
    return majority(heads.where(F.length("head").between(3, 500)), "head", "code", share, least)


def unrecognised(postings: DataFrame, heads: DataFrame) -> DataFrame:
    """(title_key, n) of open postings without a code whose head was not learned, by frequency of the key."""
    from postlake.functions.keys import title_head

    rest = postings.where("occupation_code IS NULL AND closed_at IS NULL").select(same_title(F.col("title")).alias("title_key"), title_head(F.col("title")).alias("head"))
    return rest.join(heads.select("head"), "head", "left_anti").where("title_key <> ''").groupBy("title_key").agg(F.count("*").alias("n"))


def core_status(t: Tables, now: dt.datetime, hours: int = 2) -> DataFrame:
    """One row: open sources, those unavailable, runs of the last hours, failed ones, failed tasks."""
    since = at(now - dt.timedelta(hours=hours))
    s = t["source"].where("closed_at IS NULL").agg(F.count("*").alias("sources"), F.count_if(F.col("availability") == "UNAVAILABLE").alias("unavailable"))
    r = t["crawl_run"].where(F.col("started_at") >= since).agg(F.count("*").alias("runs"), F.count_if(F.col("state") == "FAILED").alias("failed_runs"))
    k = t["task"].agg(F.count_if(F.col("state") == "FAILED").alias("failed_tasks"))
    return s.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(k))  # one row each


def digest_due(users: DataFrame, now: dt.datetime) -> DataFrame:
    """Users whose local time is 8:00 or later on a day of their digest: DAILY, WEEKDAYS, or WEEKLY on digest_day (ISO)."""
    local = F.from_utc_timestamp(F.lit(now).cast("timestamp"), F.col("time_zone"))
    own = users.withColumn("__local", local).withColumn("__dow", F.expr("extract(dayofweek_iso FROM __local)"))
    due = (F.col("frequency") == "DAILY") | ((F.col("frequency") == "WEEKDAYS") & (F.col("__dow") <= 5)) | ((F.col("frequency") == "WEEKLY") & (F.col("__dow") == F.col("digest_day")))
    return own.where(due & (F.hour("__local") >= 8)).drop("__local", "__dow")


