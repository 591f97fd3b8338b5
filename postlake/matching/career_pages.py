"""Signs of lists and ads on career pages, and the choice of a company's site from checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.keys import plain_text

# Signs of an ad's text, of an empty list, of a link to the next page, of its number.
JOB_TEXT = r"poziadavk|napln prace|ponukame|mzd[ay]|nastup|pracovn[yeo] pomer|uvazok|zivotopis|requirement|responsibilit|qualification|we offer|salary|your profile|job description|pozadavk|nabizime|anforderung|aufgaben|wir bieten|ihr profil"
NO_VACANCIES = r"(neponukame|nemame)( momentalne| v sucasnosti| aktualne| teraz)?( ziadne)?( volne)?( pracovne)? (pozicie|miesta|ponuky)|momentalne nie (su|je) (ziadn[ea] )?voln|ziadne volne (pracovne )?(pozicie|miesta)|no (open )?(positions|vacancies|openings)|currently no (open )?(positions|vacancies|openings)"
NEXT_TEXT = r"^(dalej|dalsia|dalsie|next|»|›|>|dalsia strana|nasledujuca( strana)?|next page)\s*(»|›|>)?$"
PAGE_NUMBER = r"(?i)(?:[?&](?:strana|stranka|page|p|pg)=|/(?:page|strana|stranka)/)(\d{1,4})(?=$|[&/#])"


def looks_like_vacancy(text: Column) -> Column:
    return plain_text(text).rlike(JOB_TEXT)


def says_no_vacancies(text: Column) -> Column:
    return plain_text(text).rlike(NO_VACANCIES)


def page_number(url: Column) -> Column:
    """Number of a list page in its address, 1 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(url, PAGE_NUMBER, 1), F.lit("")).try_cast("int"), F.lit(1))


def next_pages(links: DataFrame) -> DataFrame:
    """(page, url): of links (page, at, url, text, rel) the first that leads on: by rel or words, else
    the link whose text and address have the number after the page's."""
    words = (F.lower("rel") == "next") | F.trim(plain_text(F.col("text"))).rlike(NEXT_TEXT)
    number = (page_number(F.col("page")) + 1).cast("string")
    numbered = (F.trim("text") == number) & (F.regexp_extract("url", PAGE_NUMBER, 1) == number)
    rank = F.when(F.coalesce(words, F.lit(False)), 0).when(F.coalesce(numbered, F.lit(False)), 1)
    own = links.where(F.col("url") != F.col("page")).withColumn("rank", rank).where("rank IS NOT NULL")
    return own.groupBy("page").agg(F.min_by("url", F.struct("rank", "at")).alias("url"))


def site_by_name(checks: DataFrame) -> DataFrame:
    """(company_id, at, host, status, proof) from checks (company_id, at, host, verdict, known, home):
    the first address with the number is the site; else the first with the brand; else the first group
    site of a known domain; else every group site, and closed ones at the brand's own address, are
    candidates. Checks after a number don't count."""
    proof = F.when(F.col("verdict") == "REGISTRATION_NUMBER", "NUMBER").when(F.col("verdict") == "BRAND", "BRAND").when(F.col("verdict") == "GROUP", "GROUP").when((F.col("verdict") == "CLOSED") & F.col("home"), "CLOSED")
    rank = F.when(F.col("verdict") == "REGISTRATION_NUMBER", 0).when(F.col("verdict") == "BRAND", 1).when((F.col("verdict") == "GROUP") & F.col("known"), 2).otherwise(3)
    own = checks.withColumn("proof", proof).withColumn("rank", rank).where("proof IS NOT NULL")
    best = own.groupBy("company_id").agg(F.min(F.struct("rank", "at")).alias("best"))
    kept = own.join(best, "company_id").where((F.col("best.rank") == 3) | ((F.col("rank") == F.col("best.rank")) & (F.col("at") == F.col("best.at"))))
    return kept.select("company_id", "at", "host", F.when(F.col("rank") < 3, "FOUND").otherwise("CANDIDATE").alias("status"), "proof")
