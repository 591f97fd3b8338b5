"""Examples with a known occupation code, and answers for titles, kept up as postings come in.

Both are keyed by `same_title`. What one batch tells of a key is a state of fixed size (least and greatest code, least
title), and states merge, so a key whose codes contradict each other is found across any number of batches without
reading an earlier one again. Null titles and titles of an empty key have no state; empty tables give no rows; repeated
rows change nothing; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.keys import same_title
from postlake.operators import merges

C = F.col
#: Longest title that becomes an example.
MOST_CHARS = 300
#: Sources of examples in the order in which they are worked off.
PORTAL, DICTIONARY = "PORTAL", "ESCO"


def title_states(postings: DataFrame) -> DataFrame:
    """(key, low, high, text) of the coded postings (title, occupation_code) of a batch."""
    coded = postings.where((C("occupation_code").isNotNull()) & (F.length("title") <= MOST_CHARS))
    keyed = coded.select(same_title(C("title")).alias("key"), C("occupation_code").alias("code"), "title").where("key <> ''")
    return keyed.groupBy("key").agg(F.min("code").alias("low"), F.max("code").alias("high"), F.min("title").alias("text"))


def merged_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """States of both; any order and grouping of batches gives the same."""
    return old.unionByName(new).groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("text").alias("text"))


def examples(states: DataFrame, labels: DataFrame, languages: tuple[str, ...] = ("sk", "en")) -> DataFrame:
    """(source, example, text, code): titles of one code, and the dictionary's labels (label, language, code)."""
    single = states.where("low = high").select(F.lit(PORTAL).alias("source"), C("key").alias("example"), "text", C("low").alias("code"))
    said = labels.where(C("language").isin(*languages)).select(F.lit(DICTIONARY).alias("source"), C("label").alias("example"), C("label").alias("text"), "code")
    return single.unionByName(said).distinct()


def pending(wanted: DataFrame, known: DataFrame, model: str, per_code: int | None = None, most: int | None = None) -> DataFrame:
    """(source, example, text, code) that known (source, example, code, model) has no vector of the model for.

    With per_code, a code gets so many examples in all, the known ones first, then portal titles, then labels, by name;
    with most, the first of what is left in that order are worked off now. The rank is limited by Spark before its
    shuffle, so a code with very many examples sends per_code rows a task."""
    keys = ["source", "example", "code"]
    own = known.where(C("model") == model).select(*keys).distinct()
    out = wanted.join(own, keys, "left_anti")
    if per_code is not None:
        rank = F.row_number().over(Window.partitionBy("code").orderBy(*_order()))
        first = out.withColumn("rank", rank).where(C("rank") <= per_code)
        had = own.groupBy("code").agg(F.count("*").alias("had"))
        out = first.join(had, "code", "left").where(C("rank") + F.coalesce("had", F.lit(0)) <= per_code).select(*out.columns)
    return (out if most is None else out.orderBy(*_order(), "code").limit(most)).select("source", "example", "text", "code")


def _order() -> list[Column]:
    return [F.desc("source"), C("example")]


def save_examples(known: DataFrame, batch: DataFrame, model: str) -> DataFrame:
    """known (source, example, code, text, model) with a batch of examples, which replace those of other models."""
    return merges.upsert(known, batch.select("source", "example", "code", "text", F.lit(model).alias("model")), ["source", "example", "code"])


def uncoded(postings: DataFrame, matches: DataFrame, answers: DataFrame, most: int | None = None) -> DataFrame:
    """(title_key, title, n): keys of open postings that have no code, no matched position and no answer yet; with most,
    the keys of the most postings, ties by title."""
    bare = postings.where("closed_at IS NULL AND occupation_code IS NULL AND title_occupation_code IS NULL")
    bare = bare.join(matches.select("vacancy_id").distinct(), "vacancy_id", "left_anti").select(same_title(C("title")).alias("title_key"), "title")
    per = bare.where("title_key <> ''").groupBy("title_key").agg(F.min("title").alias("title"), F.count("*").alias("n"))
    out = per.join(answers.select("title_key"), "title_key", "left_anti")
    return out if most is None else out.orderBy(F.desc("n"), "title").limit(most)


def save_answers(answers: DataFrame, batch: DataFrame, model: str) -> DataFrame:
    """answers (title_key, code, model) with a batch (title, code; an empty or null code: not understood); an answer that
    is there stays. Of a batch's titles with one key the smallest answers."""
    code = F.nullif(C("code"), F.lit(""))
    keyed = batch.select(same_title(C("title")).alias("title_key"), "title", code.alias("code")).where("title_key <> ''")
    new = keyed.groupBy("title_key").agg(F.min(F.struct("title", "code"))["code"].alias("code"))
    return merges.insert_absent(answers, new.withColumn("model", F.lit(model)), ["title_key"])


def propagated(postings: DataFrame, answers: DataFrame) -> DataFrame:
    """postings with title_occupation_code filled by the answers to their keys, where they are open and have no code.

    Only the open postings without a code go to the join; the others stay where they are."""
    bare = C("closed_at").isNull() & C("occupation_code").isNull() & C("title_occupation_code").isNull()
    asks = bare & (F.coalesce(same_title(C("title")), F.lit("")) != "")
    given = answers.where("code IS NOT NULL").select(C("title_key").alias("__key"), C("code").alias("__code"))
    open_ = postings.where(asks).withColumn("__key", same_title(C("title"))).join(given, "__key", "left").withColumn("title_occupation_code", C("__code"))
    return open_.select(*postings.columns).unionByName(postings.where(~asks))
