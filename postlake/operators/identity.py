"""Which postings are of one vacancy: keys, candidate pairs, lookups for new postings.

Every signal is written as keys: a posting shows the keys under which others find it and asks for
keys itself. A vacancy is then linked with the smallest vacancies that show a key it asks for, by a join
with one row a key, so a key that very many postings share gives as many links as it has postings,
never all pairs of them. What the rule of places allows is put into keys, too: places of a kind
share a name, places of unlike kinds only the kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import keys
from postlake.functions.places import places, relation
from postlake.operators.resolve import removed, written

#: Ranks of the signals; where two link the same vacancies the smaller one is named.
NUMBER, ADDRESS, BOARD_ID, BUTTON, BUTTON_PAIR, TITLE_PLACE = range(1, 7)
SIGNALS = {NUMBER: "offer_number", ADDRESS: "address", BOARD_ID: "board_id", BUTTON: "button", BUTTON_PAIR: "button_pair", TITLE_PLACE: "title_place"}
#: What a board calls copies of one vacancy differs by a suffix there.
COPYING = "workday"


def keyed(postings: DataFrame) -> DataFrame:
    """postings (external_id, url, employer_url, title, location) with the keys that identify a vacancy."""
    return postings.select(
        "*",
        keys.title_key(F.col("title")).alias("title_key"), places(F.col("location")).alias("place_keys"), keys.offer_number(F.col("external_id"), F.col("url")).alias("number"),
        F.nullif(keys.clean_address(F.col("url")), F.lit("")).alias("address_key"), keys.link_key(F.col("url")).alias("link_key"), keys.link_key(F.col("employer_url")).alias("button_key"), keys.host(F.col("url")).alias("host"),
    )


def _key(*parts: Column) -> Column:
    """One text of several, each behind its length, so that different parts never give the same; null if one is."""
    return F.concat(*[x for p in parts for x in (F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))])


def board_keys(p: DataFrame) -> Column:
    """Keys of the third signal: provider, host and id; where a board copies also the id without suffix and the title."""
    same = _key(F.lit("id"), F.col("provider"), F.col("host"), F.col("external_id"))
    copy = F.when(F.col("provider") == COPYING, _key(F.lit("copy"), F.col("provider"), F.col("host"), keys.without_copy_suffix(F.col("external_id")), F.col("title_key")))
    return F.array_compact(F.array(same, copy))


def kinds(place_keys: Column) -> tuple[Column, Column, Column]:
    """(kind of a set of places, keys it shows, keys it asks for): two sets aren't 'different' exactly if one asks for a key that the other shows.

    Of kind c are sets with cities, of kind r those with regions alone, of kind n the others. Sets of kind c or r meet at a common
    city or region ('=...'), sets of two kinds, or both of kind n, at the kind ('~...'), which is the loose relation.
    """
    own = F.coalesce(place_keys, F.array().cast("array<string>"))
    cities, regions = F.filter(own, lambda x: F.startswith(x, F.lit("c:"))), F.filter(own, lambda x: F.startswith(x, F.lit("r:")))
    kind = F.when(F.size(cities) > 0, "c").when(F.size(regions) > 0, "r").otherwise("n")
    names = F.transform(F.when(F.size(cities) > 0, cities).otherwise(regions), lambda x: F.concat(F.lit("="), x))
    other = F.when(kind == "c", F.array(F.lit("~r"), F.lit("~n"))).when(kind == "r", F.array(F.lit("~c"), F.lit("~n"))).otherwise(F.array(F.lit("~c"), F.lit("~r"), F.lit("~n")))
    return kind, F.array_append(names, F.concat(F.lit("~"), kind)), F.concat(names, other)


#: Hashes of keys that are sent to all tasks.
SENT_HASHES = 2_000_000


def _shared(rows: DataFrame, steps: list[str]) -> DataFrame:
    """rows (rank, key, vacancy_id) without those whose key no other row has, as such link nothing; written.

    To tell them only a hash of each key is shuffled, so most of the rows never are where most keys are unique; other keys of the same hash may pass."""
    of = F.xxhash64("rank", "key")
    often = written(rows.groupBy(of.alias("hash")).count().where("count > 1").select("hash"), steps)
    often = F.broadcast(often) if often.count() <= SENT_HASHES else often
    return written(rows.withColumn("hash", of).join(often, "hash", "left_semi").drop("hash"), steps)


def _linked(shown: DataFrame, asked: DataFrame, stop: DataFrame, most: int, steps: list[str]) -> DataFrame:
    """(a, b, rank), written: vacancies a that ask for a key (rank, key) with the smallest vacancy b, if that is smaller, that shows it and isn't
    blocked. For vacancies with blocked pairs as many more of a key are looked at as any has of these, so that the smallest allowed one is among
    them. What is joined is written first, so that a small side is known to be one and the large one isn't shuffled."""
    on = ["rank", "key"]
    ask = asked.select(*on, F.col("vacancy_id").alias("a"))
    first = written(shown.groupBy(*on).agg(F.min("vacancy_id").alias("b")), steps)
    links = ask.join(first, on).where("b < a").select("a", "b", "rank")
    if most:
        few = written(ask.join(stop.select(F.col("b").alias("a")).distinct(), "a", "left_semi").distinct(), steps)
        order = Window.partitionBy(*on).orderBy("vacancy_id")  # equal ones have one rank, so that Spark limits rows before they are shuffled
        deep = shown.join(few.select(*on).distinct(), on, "left_semi").withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= most + 1).select(*on, F.col("vacancy_id").alias("b")).distinct()
        links = links.union(few.join(deep, on).where("b < a").select("a", "b", "rank"))
        links = links.join(stop.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    return written(links.groupBy("a").agg(F.min(F.struct("b", "rank")).alias("t")).select("a", "t.b", "t.rank"))


def merge_pairs(postings: DataFrame, employers: DataFrame, blocked: DataFrame | None = None, portal: str = "profesia:") -> DataFrame:
    """(a, b, rank): links of vacancies by six signals, enough of them for `resolve.keepers` to merge as it would by all pairs.

    postings are the open ones of vacancies that aren't closed (vacancy_id, provider, external_id, and what keyed() adds), employers
    their companies (vacancy_id, company_id, title_key), blocked pairs (a, b), the smaller one first, that must stay apart.

    1 the portal's number; 2 the address; 3 provider, host and board id; 4 an ad's button leads to the only own posting with
    that link, and the titles are the same; 5 the buttons and titles are the same and the places don't contradict; 6 company and
    title are the same, and the places too, or they don't contradict and the company has just two such vacancies. A vacancy
    whose button leads to another title takes no part in 6. Null keys and empty titles link nothing.

    Signals are linked one after the other, in steps that are written and removed, so that disk holds the largest of them and not all.
    """
    p, whole_time, steps = postings, [], []
    spark = p.sparkSession
    stop = written(spark.createDataFrame([], "a long, b long") if blocked is None else blocked.select("a", "b").distinct(), whole_time)
    most = stop.groupBy("b").count().agg(F.coalesce(F.max("count"), F.lit(0))).collect()[0][0]  # one row
    one = lambda rank, key, rows=p: rows.select("vacancy_id", F.lit(rank).alias("rank"), key.alias("key")).where("key IS NOT NULL")
    spread = lambda rows, names, *base: rows.select("vacancy_id", F.explode(names).alias("place"), *base)
    # number, address, board
    board = p.select("vacancy_id", F.lit(BOARD_ID).alias("rank"), F.explode(board_keys(p)).alias("key"))
    same = one(NUMBER, F.col("number")).union(_shared(one(ADDRESS, F.col("address_key")), steps)).union(_shared(board, steps))
    made = [_linked(same, same, stop, most, steps)]
    removed(spark, steps)
    # buttons: an ad and the only own posting that it leads to, and ads that lead to one page
    _, shows, asks = kinds(F.col("place_keys"))
    ads = written(p.where("button_key IS NOT NULL").select("vacancy_id", "button_key", "title_key", shows.alias("shows"), asks.alias("asks")), steps)
    buttons = written(ads.select(F.col("button_key").alias("link_key")).distinct(), steps)
    aimed = written(p.join(buttons, "link_key", "left_semi").select("vacancy_id", "link_key", "title_key", F.startswith("external_id", F.lit(portal)).alias("portal")), steps)
    own = aimed.where("NOT portal").groupBy("link_key").agg(F.count("*").alias("n"), F.min("vacancy_id").alias("vacancy_id"), F.min("title_key").alias("title_key")).where("n = 1")
    titled = ads.where("title_key <> ''")
    button = [F.col("button_key"), F.col("title_key")]
    aim = lambda way: one(BUTTON, _key(F.lit(way), F.col("link_key"), F.col("title_key")), own)
    ad = lambda way: one(BUTTON, _key(F.lit(way), *button), titled)
    pair = lambda names: one(BUTTON_PAIR, _key(F.col("place"), *button), spread(titled, names, *button))
    made.append(_linked(aim("own").union(ad("ad")).union(pair("shows")), ad("own").union(aim("ad")).union(pair("asks")), stop, most, steps))  # the ad may be the older one
    # titles of a company
    leads = written(aimed.groupBy(F.col("link_key").alias("button_key")).agg(F.min("title_key").alias("least"), F.max("title_key").alias("most")), steps)
    veto = F.coalesce(F.expr("least <> title_key OR most <> title_key"), F.lit(False))
    whole = p.select("vacancy_id", "place_keys", "button_key", "title_key").join(leads, "button_key", "left").groupBy("vacancy_id").agg(F.array_distinct(F.flatten(F.collect_set("place_keys"))).alias("place_keys"), F.max(veto).alias("vetoed"))  # a vacancy's places are few
    e = employers.select("vacancy_id", "company_id", "title_key").where("title_key <> ''").repartition("vacancy_id").distinct()
    e = written(e.join(whole, "vacancy_id", "left").select("vacancy_id", "company_id", "title_key", "vetoed", shows.alias("shows"), asks.alias("asks")), steps)
    company = [F.col("company_id"), F.col("title_key")]
    two = written(e.groupBy(*company).count().where("count = 2").select(*company, F.lit(True).alias("two")), steps)
    e = e.where("NOT vetoed").join(two, ["company_id", "title_key"], "left")
    loose = F.startswith("place", F.lit("~"))
    side = lambda names: one(TITLE_PLACE, _key(F.col("place"), *company), spread(e, names, *company, "two").where(~loose | F.col("two").isNotNull()))
    made.append(_linked(side("shows"), side("asks"), stop, most, steps))
    removed(spark, steps + whole_time)
    return made[0].union(made[1]).union(made[2])


def strong_match(new: DataFrame, known: DataFrame) -> DataFrame:
    """new (k, and what keyed() adds to postings) with vacancy_id: that of the first signal that finds one, its smallest; null for none.

    Signals are the portal's number, the address, and provider, host and board id (for copies without suffix, with the title).
    known are the open postings of vacancies that aren't closed. A micro-batch is joined with one row for each key of known."""
    def asked(rows: DataFrame, *more: str) -> DataFrame:
        signals = F.array(F.struct(F.lit(NUMBER).alias("signal"), F.array(F.col("number")).alias("of")), F.struct(F.lit(ADDRESS).alias("signal"), F.array(F.col("address_key")).alias("of")), F.struct(F.lit(BOARD_ID).alias("signal"), board_keys(rows).alias("of")))
        return rows.select(*more, F.explode(signals).alias("s")).select(*more, F.col("s.signal").alias("signal"), F.explode("s.of").alias("key")).where("key IS NOT NULL")

    first = asked(known, "vacancy_id").groupBy("signal", "key").agg(F.min("vacancy_id").alias("found"))
    best = asked(new, "k").join(first, ["signal", "key"]).groupBy("k").agg(F.min(F.struct("signal", "found")).alias("b"))
    return new.join(best.select("k", F.col("b.found").alias("vacancy_id"), F.col("b.signal").alias("signal")), "k", "left")


def title_and_place(new: DataFrame, known: DataFrame, employers: DataFrame) -> DataFrame:
    """new (k, source_id, title_key, place_keys) with vacancy_id: of the vacancies that the source's employer has with that title, the smallest whose
    places are the same; else the only one, if its places don't contradict; null for none.

    employers are (company_id, source_id) of employers' own sources and (company_id, external_id) of ads elsewhere, the other column null; known are
    the open postings. A vacancy's places are those of all its postings with that title there."""
    own = employers.where("source_id IS NOT NULL AND company_id IS NOT NULL").select("company_id", "source_id").distinct()
    ads = employers.where("external_id IS NOT NULL").select("company_id", "external_id").distinct()
    # sources of the same companies ask alike; a source's companies are few
    asker = own.groupBy("source_id").agg(F.array_sort(F.collect_set("company_id")).alias("who"))
    sets = asker.select("who").distinct().select("who", F.explode("who").alias("company_id"))
    # written, so that keys are computed once
    c = written(known.select("source_id", "external_id", "vacancy_id", "title_key", F.col("place_keys").alias("places"))).where("title_key <> ''")
    of = c.join(own, "source_id").select("company_id", "title_key", "vacancy_id", "places").union(c.join(ads, "external_id").select("company_id", "title_key", "vacancy_id", "places"))
    # a source of several companies sees the vacancies of all; a vacancy that two of them have is one candidate
    seen = of.join(sets, "company_id").select("who", "title_key", "vacancy_id", F.explode_outer("places").alias("place"))
    seen = written(seen.groupBy("who", "title_key", "vacancy_id").agg(F.collect_set("place").alias("places")))  # a vacancy's places are few
    asked = written(new.select("k", "source_id", "title_key", "place_keys")).where("title_key <> ''").join(asker, "source_id")
    # places are the same at a common name, so one row a name and title tells the smallest such vacancy
    name = lambda of_: F.explode(F.filter(kinds(F.col(of_))[1], lambda x: ~F.startswith(x, F.lit("~")))).alias("place")
    smallest = seen.select("who", "title_key", "vacancy_id", name("places")).groupBy("who", "title_key", "place").agg(F.min("vacancy_id").alias("v"))
    same = asked.select("k", "who", "title_key", name("place_keys")).join(smallest, ["who", "title_key", "place"]).groupBy("k").agg(F.min("v").alias("same"))
    single = seen.groupBy("who", "title_key").agg(F.count("*").alias("n"), F.min("vacancy_id").alias("only"), F.min("places").alias("places")).where("n = 1")
    loose = asked.join(single, ["who", "title_key"]).where(relation(F.col("place_keys"), F.col("places")) == "loose").groupBy("k").agg(F.min("only").alias("only"))
    found = same.join(loose, "k", "full")
    return new.join(found, "k", "left").withColumn("vacancy_id", F.coalesce("same", "only")).drop("same", "only")
