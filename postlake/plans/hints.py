"""Demonstration queries of hints at portal positions, and of examples and answers for titles.

Portal positions and the dictionary come from part, postings from lineitem, by portable SELECTs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions.keys import same_title
from postlake.matching import examples, hints
from postlake.plans.domain import VIEWS as DOMAIN
from postlake.plans.domain import duck_text, spark_text
from postlake.plans.registry import Registry

R = Registry()
C = F.col
MODEL = "m2"

VIEWS = {
    "job_posting": DOMAIN["job_posting"],
    "vacancy_position_match": DOMAIN["vacancy_position_match"],
    "portal_position": """SELECT 's' || p_partkey AS slug, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || '/' || p_type ELSE p_type || 's (' || p_name || ')' END AS name,
      CASE WHEN p_partkey % 5 = 0 THEN 'G' || (p_size % 7) END AS code, CASE WHEN p_partkey % 10 = 0 THEN 'OWNER' WHEN p_partkey % 3 = 0 THEN 'MODEL' END AS mapped_by, DATE '2024-01-01' + CAST(p_size AS INT) AS mapped_at FROM part""",
    "ad_position": "SELECT 10000 + p_partkey AS num, 's' || p_partkey AS slug FROM part UNION ALL SELECT 10000 + p_partkey AS num, 's' || CAST(floor(p_partkey / 7) AS BIGINT) AS slug FROM part WHERE p_size % 3 = 0",
    "dictionary": "SELECT p_size AS id, min_by(p_name, p_partkey) AS name, p_size % 9 <> 0 AS active, CASE WHEN p_size % 8 <> 0 THEN 'G' || (p_size % 7) END AS occupation_code FROM part GROUP BY p_size",
    "position_term": """SELECT p_size AS position_id, 'TITLE' AS kind, max_by(p_name, p_partkey) AS term FROM part GROUP BY p_size UNION ALL SELECT p_size, 'ROLE', split_part(min_by(p_name, p_retailprice * 7 % 100 + p_partkey / 100000.0), ' ', 2) FROM part GROUP BY p_size
      UNION ALL SELECT p_size, 'KEYWORD', max_by(p_type, p_partkey) FROM part GROUP BY p_size UNION ALL SELECT p_size, 'EXCLUDE', split_part(max_by(p_name, p_partkey), ' ', 1) FROM part WHERE p_size % 4 = 0 GROUP BY p_size""",
    "occupation_group": "SELECT DISTINCT 'G' || (p_size % 6) AS code, 'Group ' || (p_size % 6) AS name FROM part",
    "titled": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS vacancy_id, CASE l_partkey % 3 WHEN 0 THEN 'Driver ' WHEN 1 THEN 'DRIVER ' ELSE 'Cook ' END || (l_partkey % 500) || CASE WHEN l_linenumber = 2 THEN ' (m/z)' ELSE '' END AS title,
      CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS closed_at, CASE WHEN l_quantity > 30 AND l_partkey % 4 > 0 THEN 'G' || CASE WHEN l_discount = 0.1 AND l_partkey % 500 < 100 THEN 9 ELSE l_partkey % 500 % 6 END END AS occupation_code,
      CASE WHEN l_quantity < 5 THEN 'G' || (l_partkey % 6) END AS title_occupation_code, l_shipdate AS day FROM lineitem""",
    "label": "SELECT p_name || ' ' || (p_partkey % 90) AS label, CASE p_partkey % 3 WHEN 0 THEN 'sk' WHEN 1 THEN 'en' ELSE 'de' END AS language, 'G' || (p_size % 6) AS code FROM part",
    "known": f"SELECT 'ESCO' AS source, p_name || ' ' || (p_partkey % 90) AS example, 'G' || (p_size % 6) AS code, p_name AS text, CASE WHEN p_partkey % 2 = 0 THEN '{MODEL}' ELSE 'm1' END AS model FROM part WHERE p_partkey % 90 < 45 UNION SELECT 'PORTAL', 'driver ' || (p_partkey % 500), 'G' || (p_partkey % 500 % 6), p_name, '{MODEL}' FROM part WHERE p_partkey % 500 < 150 AND p_size < 9",
    "answer": "SELECT 'cook ' || (p_partkey % 500) AS title_key, CASE WHEN min(p_size) % 2 = 0 THEN 'G' || (min(p_size) % 6) END AS code, 'm1' AS model FROM part WHERE p_size < 25 GROUP BY p_partkey % 500",
    "answered": "SELECT CASE p_partkey % 3 WHEN 0 THEN 'Driver ' ELSE 'COOK ' END || (p_partkey % 500) AS title, CASE WHEN min(p_size) % 4 = 0 THEN '' ELSE 'G' || (min(p_size) % 6) END AS code FROM part GROUP BY p_partkey % 3, p_partkey % 500",
}
TABLES = ("lineitem", "part")


def frame(t, name: str) -> DataFrame:
    text = spark_text(VIEWS[name])
    frames = {x: t(x) for x in TABLES if re.search(rf"\b(?:FROM|JOIN) {x}\b", text)}
    for x in frames:
        text = re.sub(rf"\b(FROM|JOIN) {x}\b", rf"\1 {{{x}}}", text)
    return next(iter(frames.values())).sparkSession.sql(text, **frames)


def sql(body: str) -> str:
    """The oracle's text with the views that it names."""
    used = [f"{k} AS ({duck_text(v)})" for k, v in VIEWS.items() if re.search(rf"\b{k}\b", body)]
    return "WITH " + ", ".join(used) + body


_LINKS = ", linked AS (SELECT DISTINCT a.slug, j.vacancy_id AS v FROM ad_position a JOIN job_posting j ON j.external_id = 'profesia:' || a.num AND j.closed_at IS NULL)"


def _links(t) -> DataFrame:
    return hints.ad_vacancies(frame(t, "ad_position"), frame(t, "job_posting"))


@R.add("q16_unmapped_positions", sql(_LINKS + """, found AS (SELECT vacancy_id AS v FROM vacancy_position_match UNION SELECT vacancy_id FROM job_posting WHERE closed_at IS NULL AND (occupation_code IS NOT NULL OR title_occupation_code IS NOT NULL)
  UNION SELECT v FROM linked WHERE slug IN (SELECT slug FROM portal_position WHERE code IS NOT NULL))
SELECT p.slug, p.name, count(*) AS vacancies, count(*) - count(f.v) AS unseen FROM portal_position p JOIN linked l USING (slug) LEFT JOIN found f ON f.v = l.v WHERE p.code IS NULL GROUP BY p.slug, p.name"""))
def unmapped(t):
    return hints.unmapped(frame(t, "portal_position"), _links(t), frame(t, "job_posting"), frame(t, "vacancy_position_match"))


@R.add("q16_assigned_positions", sql(_LINKS + """ SELECT p.slug, p.name, p.code, g.name AS group_name, (SELECT count(*) FROM linked l WHERE l.slug = p.slug) AS vacancies, 'assigned ' || strftime(p.mapped_at, '%Y-%m-%d') AS hint
FROM portal_position p JOIN occupation_group g ON g.code = p.code WHERE p.mapped_by = 'OWNER'"""))
def assigned(t):
    return hints.assigned(frame(t, "portal_position"), _links(t), frame(t, "occupation_group"))


@R.add("q16_dictionary_hints", sql(r""", term AS (SELECT position_id, kind, lower(term) AS term FROM position_term UNION SELECT id, 'TITLE', lower(name) FROM dictionary),
hit AS (SELECT p.slug, w.position_id, list(DISTINCT w.kind) AS kinds FROM portal_position p JOIN term w ON regexp_matches(lower(p.name), '(^|[^a-z0-9])' || w.term || '($|[^a-z0-9])') GROUP BY 1, 2)
SELECT h.slug, d.occupation_code AS code, g.name AS group_name, 'dictionary: ' || min(d.name) AS hint FROM hit h JOIN dictionary d ON d.id = h.position_id JOIN occupation_group g ON g.code = d.occupation_code
WHERE d.active AND NOT list_contains(kinds, 'EXCLUDE') AND (list_contains(kinds, 'TITLE') OR list_has_all(kinds, ['ROLE', 'KEYWORD'])) GROUP BY 1, 2, 3"""))
def dictionary(t):
    return hints.dictionary_hints(frame(t, "portal_position"), frame(t, "dictionary"), frame(t, "position_term"), frame(t, "occupation_group"))


@R.add("q16_neighbour_hints", sql(_LINKS + """, code AS (SELECT l.v, p.code FROM linked l JOIN portal_position p USING (slug) WHERE p.code IS NOT NULL UNION SELECT vacancy_id, unnest([occupation_code, title_occupation_code]) FROM job_posting WHERE closed_at IS NULL
  UNION SELECT m.vacancy_id, d.occupation_code FROM vacancy_position_match m JOIN dictionary d ON d.id = m.position_id)
SELECT slug, code, g.name AS group_name, n AS votes, total, row_number() OVER (PARTITION BY slug ORDER BY n DESC, code) AS rank, n || ' of ' || total || ' ads' AS hint
FROM (SELECT slug, c.code, count(*) AS n FROM linked JOIN code c USING (v) GROUP BY 1, 2) x JOIN (SELECT slug, count(*) AS total FROM linked GROUP BY 1) y USING (slug) JOIN occupation_group g USING (code) QUALIFY rank <= 3"""))
def neighbours(t):
    links = _links(t)
    codes = hints.known_codes(frame(t, "portal_position"), links, frame(t, "job_posting"), frame(t, "vacancy_position_match"), frame(t, "dictionary"))
    return hints.neighbour_hints(links, codes, frame(t, "occupation_group"), 3)


_KEY = r"trim(regexp_replace(regexp_replace(lower(title), '\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_WANTED = f""", wanted AS (SELECT 'PORTAL' AS source, {_KEY} AS example, min(title) AS text, min(occupation_code) AS code FROM titled WHERE occupation_code IS NOT NULL GROUP BY 2 HAVING count(DISTINCT occupation_code) = 1
  UNION SELECT 'ESCO', label, label, code FROM label WHERE language <> 'de')"""
_LEFT = f"{_WANTED}, rest AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.source = w.source AND k.example = w.example AND k.code = w.code AND k.model = '{MODEL}'))"


def _states(t) -> DataFrame:
    """Of the postings in two batches, by the parity of their vacancies."""
    rows = frame(t, "titled")
    batches = [examples.title_states(rows.where(C("vacancy_id") % 2 == i)) for i in (0, 1)]
    return examples.merged_states(*batches)


@R.add("v03_pending_examples", sql(_LEFT + " SELECT source, example, text, code FROM rest"))
def pending(t):
    return examples.pending(examples.examples(_states(t), frame(t, "label")), frame(t, "known"), MODEL)


@R.add("v03_capped_examples", sql(_LEFT + f""", had AS (SELECT code, count(*) AS had FROM (SELECT DISTINCT source, example, code FROM known WHERE model = '{MODEL}') GROUP BY 1)
SELECT source, example, text, code FROM (SELECT r.*, coalesce(had, 0) + row_number() OVER (PARTITION BY code ORDER BY source DESC, example) AS place FROM rest r LEFT JOIN had USING (code)) WHERE place <= 200"""))
def capped(t):
    return examples.pending(examples.examples(_states(t), frame(t, "label")), frame(t, "known"), MODEL, per_code=200)


@R.add("v03_saved_examples", sql(_LEFT + f""" SELECT source, example, code, coalesce(r.text, k.text) AS text, CASE WHEN r.source IS NULL THEN k.model ELSE '{MODEL}' END AS model
FROM (SELECT source, example, code, max(text) AS text, max(model) AS model FROM known GROUP BY 1, 2, 3) k FULL JOIN rest r USING (source, example, code)"""))
def saved(t):
    known = frame(t, "known").groupBy("source", "example", "code").agg(F.max("text").alias("text"), F.max("model").alias("model"))
    return examples.save_examples(known, examples.pending(examples.examples(_states(t), frame(t, "label")), known, MODEL), MODEL)


@R.add("v04_answer_cache", sql(f""", batch AS (SELECT lower(title) AS title_key, nullif(min_by(code, title), '') AS code FROM answered GROUP BY 1), cache AS (FROM answer UNION ALL SELECT *, '{MODEL}' FROM batch WHERE title_key NOT IN (SELECT title_key FROM answer))
SELECT j.id, coalesce(j.title_occupation_code, CASE WHEN j.closed_at IS NULL AND j.occupation_code IS NULL THEN c.code END) AS title_occupation_code, c.model FROM titled j LEFT JOIN cache c ON c.title_key = {_KEY}"""))
def answers(t):
    cache = examples.save_answers(frame(t, "answer"), frame(t, "answered"), MODEL)
    rows = examples.propagated(frame(t, "titled"), cache)
    models = cache.select(C("title_key").alias("__key"), "model")
    return rows.join(models, same_title(C("title")) == C("__key"), "left").select("id", "title_occupation_code", "model")


@R.add("v04_unanswered_titles", sql(f" SELECT {_KEY} AS title_key, min(title) AS title, count(*) AS n FROM titled WHERE closed_at IS NULL AND occupation_code IS NULL AND title_occupation_code IS NULL AND vacancy_id NOT IN (SELECT vacancy_id FROM vacancy_position_match) AND {_KEY} NOT IN (SELECT title_key FROM answer) GROUP BY 1"))
def unanswered(t):
    return examples.uncoded(frame(t, "titled"), frame(t, "vacancy_position_match"), frame(t, "answer"))
