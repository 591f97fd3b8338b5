"""Hints at the occupation group of the positions of an offer portal.

Tables: positions (slug, name, code, mapped_by, mapped_at), ads (num, slug), postings (vacancy_id, external_id, closed_at,
occupation_code, title_occupation_code), matches (vacancy_id, position_id), dictionary (id, name, active, occupation_code),
terms (position_id, kind, term), groups (code, name). A posting is of an ad if its external_id is `profesia:` and the ad's
number; closed postings don't count. Null keys join nothing, empty tables give no rows, repeated rows count once, and
further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.operators.joins import sized
from postlake.tables import spread

C = F.col
#: Titles that one task looks for terms in.
TASK_TITLES = 20_000
_TOKEN, _EDGE = r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])", r"[^\p{L}\p{N}]"


def _tokens(text: Column) -> Column:
    """Words and single marks of a text."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), 1)


def _index_token(term: Column) -> Column:
    """The longest token of a term, the first of equals; null if it has none."""
    ranked = F.transform(_tokens(term), lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at"), w.alias("token")))
    return F.array_max(ranked)["token"]


def _pattern(term: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(f"(?:^|{_EDGE})"), quoted, F.lit(rf"(?:\z|{_EDGE})"))


def term_hits(titles: DataFrame, terms: DataFrame) -> DataFrame:
    """(slug, position_id, kind) of the terms that stand in titles (slug, name) as whole words, whatever their case.

    An index of one token a term proposes the candidates: every word or mark of a term is one of a title that has it, so the
    longest is looked up, and what it finds is compared in full. Null and blank terms stand nowhere. Titles are dealt by slug
    to tasks of bounded size, so a slug's hits are made distinct, and grouped later, where they are found."""
    low = spread(titles.select("slug", F.lower("name").alias("low")).where("low IS NOT NULL"), TASK_TITLES, "slug")
    said = low.withColumn("token", F.explode(F.array_distinct(_tokens(C("low")))))
    asked = terms.select("position_id", "kind", F.lower("term").alias("term")).distinct()
    asked = asked.select("position_id", "kind", _index_token(C("term")).alias("token"), _pattern(C("term")).alias("pattern")).where("token IS NOT NULL")
    return said.join(sized(asked), "token").where(F.rlike(C("low"), C("pattern"))).select("slug", "position_id", "kind").distinct()


def dictionary_hints(titles: DataFrame, dictionary: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(slug, code, group_name, hint): groups of the active positions whose name or title is in a portal position's name, or
    a role together with a keyword, and no excluded word; of a group's positions the first by name is told."""
    names = dictionary.select(C("id").alias("position_id"), F.lit("TITLE").alias("kind"), C("name").alias("term"))
    hits = term_hits(titles, terms.select("position_id", "kind", "term").unionByName(names))
    has = {kind: F.coalesce(F.bool_or(C("kind") == kind), F.lit(False)).alias(kind) for kind in ("TITLE", "ROLE", "KEYWORD", "EXCLUDE")}
    meant = hits.groupBy("slug", "position_id").agg(*has.values()).where("NOT EXCLUDE AND (TITLE OR ROLE AND KEYWORD)")
    own = dictionary.where("active AND occupation_code IS NOT NULL").select(C("id").alias("position_id"), C("name").alias("position"), C("occupation_code").alias("code"))
    first = meant.join(own, "position_id").groupBy("slug", "code").agg(F.min("position").alias("position"))
    return first.join(_named(groups), "code").select("slug", "code", "group_name", F.concat(F.lit("dictionary: "), "position").alias("hint"))


def _named(groups: DataFrame) -> DataFrame:
    return groups.select("code", C("name").alias("group_name")).where("code IS NOT NULL").groupBy("code").agg(F.min("group_name").alias("group_name"))


def _open(postings: DataFrame) -> DataFrame:
    return postings.where("closed_at IS NULL AND vacancy_id IS NOT NULL")


def ad_vacancies(ads: DataFrame, postings: DataFrame) -> DataFrame:
    """(slug, vacancy_id) of open postings of the ads, each once."""
    numbered = ads.select("slug", F.concat(F.lit("profesia:"), C("num").cast("string")).alias("external_id"))
    return _open(postings).select("vacancy_id", "external_id").join(numbered, "external_id").select("slug", "vacancy_id").where("slug IS NOT NULL").distinct()


def known_codes(positions: DataFrame, links: DataFrame, postings: DataFrame, matches: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(vacancy_id, code) by four ways: positions of its ads, codes of portals, codes by title, matched positions.
    links as ad_vacancies gives them."""
    coded = positions.where("code IS NOT NULL").select("slug", "code")
    matched = dictionary.where("occupation_code IS NOT NULL").select(C("id").alias("position_id"), C("occupation_code").alias("code"))
    said = F.array("occupation_code", "title_occupation_code")
    ways = [
        links.join(coded, "slug").select("vacancy_id", "code"),
        _open(postings).select("vacancy_id", F.explode(said).alias("code")).where("code IS NOT NULL"),
        matches.join(matched, "position_id").where("vacancy_id IS NOT NULL").select("vacancy_id", "code"),
    ]
    return reduce(DataFrame.unionByName, ways).distinct()


def neighbour_hints(links: DataFrame, codes: DataFrame, groups: DataFrame, most: int | None = None) -> DataFrame:
    """(slug, code, group_name, votes, total, rank, hint): groups that the vacancies of a portal position have by other ways,
    one vote a vacancy and group; ranks by votes, ties by code; `most` keeps the first of each position.

    Groups of no name are told of nowhere and take no rank. Votes are counted before anything is ranked, so a position
    has at most as many rows in the window as there are groups."""
    total = links.groupBy("slug").agg(F.count("*").alias("total"))
    votes = links.join(codes, "vacancy_id").groupBy("slug", "code").agg(F.count("*").alias("votes")).join(_named(groups), "code")
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("votes"), "code"))
    out = votes.withColumn("rank", rank.cast("long"))
    out = out if most is None else out.where(C("rank") <= most)
    hint = F.concat(C("votes").cast("string"), F.lit(" of "), C("total").cast("string"), F.lit(" ads"))
    return out.join(total, "slug").select("slug", "code", "group_name", "votes", "total", "rank", hint.alias("hint"))


def unmapped(positions: DataFrame, links: DataFrame, postings: DataFrame, matches: DataFrame) -> DataFrame:
    """(slug, name, vacancies, unseen) of positions without a code that have open vacancies; unseen are those that no search
    finds: neither matched nor coded by any open posting or by another position of an ad."""
    bare = positions.where("code IS NULL").select("slug", "name")
    coded = links.join(positions.where("code IS NOT NULL").select("slug"), "slug", "left_semi").select("vacancy_id")
    said = _open(postings).where("coalesce(occupation_code, title_occupation_code) IS NOT NULL").select("vacancy_id")
    seen = reduce(DataFrame.unionByName, [coded, said, matches.select("vacancy_id")]).where("vacancy_id IS NOT NULL").distinct().withColumn("seen", F.lit(1))
    per = links.join(bare.select("slug").distinct(), "slug", "left_semi").join(seen, "vacancy_id", "left").groupBy("slug").agg(F.count("*").alias("vacancies"), F.count_if(C("seen").isNull()).alias("unseen"))
    return per.join(bare.distinct(), "slug").select("slug", "name", "vacancies", "unseen")


def assigned(positions: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """(slug, name, code, group_name, vacancies, hint) of positions whose code an owner chose; 0 without open vacancies."""
    own = positions.where("mapped_by = 'OWNER' AND code IS NOT NULL").join(_named(groups), "code")
    per = links.groupBy("slug").agg(F.count("*").alias("vacancies"))
    hint = F.concat(F.lit("assigned "), F.date_format("mapped_at", "yyyy-MM-dd"))
    return own.join(per, "slug", "left").select("slug", "name", "code", "group_name", F.coalesce("vacancies", F.lit(0)).alias("vacancies"), hint.alias("hint"))
