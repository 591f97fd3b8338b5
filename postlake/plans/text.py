"""Demonstration queries: keys, addresses, places, dates, JSON, digests, matching, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions import keys, places, scalars
from postlake.matching import languages, locations, neighbours, positions
from postlake.plans.registry import Registry
from postlake.tables import spread

R = Registry()

#: Titles made of whole texts, with the marks that titles carry.
_TITLE = """CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '(m/ž/d) ' WHEN 2 THEN 'Kuchár/ka ' WHEN 3 THEN '(TOBI s.r.o.) ' WHEN 4 THEN 'Вчитель ' ELSE 'SKLADNÍK - ' END || text
|| CASE doc_id % 5 WHEN 0 THEN ' (muž/žena)' WHEN 1 THEN ' 1 500 €' WHEN 2 THEN ' od 1200 EUR/mes. brutto' WHEN 3 THEN ' - Bratislava' ELSE ' | m/ž' END"""


def _line():
    """The text of a document, which stands for a title or a name."""
    return F.col("text")


def _dealt(docs: DataFrame) -> DataFrame:
    """doc_id and text over tasks of 2,000 documents or so: whole texts are long for a title's patterns, and a file may be read in one task."""
    return spread(docs.select("doc_id", "text"), 2_000)


def _title():
    d = F.col("doc_id")
    head = F.when(d % 6 == 0, "").when(d % 6 == 1, "(m/ž/d) ").when(d % 6 == 2, "Kuchár/ka ").when(d % 6 == 3, "(TOBI s.r.o.) ").when(d % 6 == 4, "Вчитель ").otherwise("SKLADNÍK - ")
    tail = F.when(d % 5 == 0, " (muž/žena)").when(d % 5 == 1, " 1 500 €").when(d % 5 == 2, " od 1200 EUR/mes. brutto").when(d % 5 == 3, " - Bratislava").otherwise(" | m/ž")
    return F.concat(head, _line(), tail)


def _sq(text: str) -> str:
    return text.replace("'", "''")


def _chain(inner: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        inner = f"regexp_replace({inner}, '{_sq(pattern)}', '{new}', 'g')"
    return inner


_BARE = tuple((p, " ") for p in (keys.SALARY, keys.EURO_FIRST, keys.GENDER, "[^a-z0-9]+"))


@R.add("x01_fold", f"SELECT doc_id, translate(lower(text), '{keys.SEARCH_FROM}', '{keys.SEARCH_TO}') AS folded FROM documents")
def x01(t):
    return t("documents").select("doc_id", keys.fold(F.col("text")).alias("folded"))


@R.add("x02_title_head", f"SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower({_TITLE}), '{keys.HEAD_FROM}', '{keys.HEAD_TO}'), '(?s)\\s*([|,/(–]|\\s-\\s).*$', ''), '\\s+', ' ', 'g')) AS head FROM documents")
def x02(t):
    return t("documents").select("doc_id", keys.title_head(_title()).alias("head"))


_FOLD = f"lower(translate({_TITLE}, '{keys.TITLE_FROM}', '{keys.TITLE_TO}'))"


@R.add("x03_same_title", "SELECT doc_id, trim(" + _chain(_FOLD, (r"\([^)]*\)", " "), *_BARE) + ") AS title FROM documents")
def x03(t):
    return _dealt(t("documents")).select("doc_id", keys.same_title(_title()).alias("title"))


def _plain(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for a, b in keys.CYRILLIC:
        out = f"replace({out}, '{a}', '{b}')"
    return f"translate({out}, '{keys.TEXT_FROM}', '{keys.TEXT_TO}')"


@R.add("x04_plain_text", f"SELECT doc_id, {_plain(_TITLE)} AS title FROM documents")
def x04(t):
    return t("documents").select("doc_id", keys.plain_text(_title()).alias("title"))


@R.add("x05_title_key", "SELECT doc_id, trim(" + _chain(_plain(_TITLE), (keys.LEGAL_PAREN, " "), *_BARE) + ") AS title_key FROM documents")
def x05(t):
    return _dealt(t("documents")).select("doc_id", keys.title_key(_title()).alias("title_key"))


_PLACES = ["Topoľčany - Topoľčany", "Hlavná 19, 949 01 Nitra", "Bratislava-Petržalka; Košice IV", "okres Trnava", "Žilinský kraj", "Slovensko", "Remote", "Banská Bystrica, Slovakia", "Prešov (SK); Prešovský kraj", ""]
_PLACE_SQL = "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_PLACES)) + ")"
_GENERAL = ", ".join(f"'{g}'" for g in places.GENERAL)


def _places_sql(column: str) -> str:
    seg = f"flatten(list_transform(string_split(regexp_replace({_plain(column)}, '\\([^)]*\\)', ' ', 'g'), ';'), lambda p: string_split(split_part(p, ' - ', 1), ',')))"
    seg = f"list_filter(list_transform({seg}, lambda s: trim(s)), lambda s: NOT regexp_matches(s, '\\d\\S*$'))"
    seg = f"list_transform({seg}, lambda s: regexp_replace(trim(regexp_replace(regexp_replace(s, '\\S*\\d\\S*', ' ', 'g'), '[^a-z]+', ' ', 'g')), '^(okres|slovakia|slovensko)\\s+', ''))"
    seg = f"list_filter({seg}, lambda s: length(s) >= 3 AND s NOT IN ({_GENERAL}))"
    seg = f"list_transform({seg}, lambda s: CASE WHEN regexp_matches(s, '^(bratislava|kosice)( |$)') THEN 'c:' || split_part(s, ' ', 1) WHEN regexp_matches(s, '\\bkraj\\b') THEN 'r:' || s ELSE 'c:' || s END)"
    return f"list_sort(list_distinct({seg}))"


def _location():
    return F.get(F.array(*map(F.lit, _PLACES)), (F.col("c_custkey") % len(_PLACES)).cast("int"))


@R.add("x06_places", f"SELECT c_custkey, {_places_sql('p.v')} AS places FROM customer JOIN {_PLACE_SQL} p(k, v) ON k = c_custkey % {len(_PLACES)}")
def x06(t):
    return t("customer").select("c_custkey", places.places(_location()).alias("places"))


_REL = f"""WITH p AS (SELECT k, {_places_sql('v')} AS a FROM {_PLACE_SQL} x(k, v)),
q AS (SELECT k, list_filter(a, lambda x: starts_with(x, 'c:')) AS c, list_filter(a, lambda x: starts_with(x, 'r:')) AS r FROM p)
SELECT x.k AS k1, y.k AS k2, CASE WHEN len(x.c) > 0 AND len(y.c) > 0 THEN CASE WHEN list_has_any(x.c, y.c) THEN 'same' ELSE 'different' END
  WHEN len(x.c) = 0 AND len(y.c) = 0 AND len(x.r) > 0 AND len(y.r) > 0 THEN CASE WHEN list_has_any(x.r, y.r) THEN 'same' ELSE 'different' END ELSE 'loose' END AS relation
FROM q x, q y"""


@R.add("x07_relation", f"SELECT p_partkey, relation FROM part JOIN ({_REL}) ON k1 = p_partkey % {len(_PLACES)} AND k2 = p_size % {len(_PLACES)}")
def x07(t):
    """How the two places of every part relate."""
    of = lambda n: places.places(F.get(F.array(*map(F.lit, _PLACES)), (n % len(_PLACES)).cast("int")))
    return t("part").select("p_partkey", places.relation(of(F.col("p_partkey")), of(F.col("p_size"))).alias("relation"))


@R.add("x08_offer_number", f"SELECT page_id, nullif(regexp_extract(CASE page_id % 3 WHEN 0 THEN 'profesia:' || (10000 + page_id) WHEN 1 THEN 'x' ELSE '' END || ' ' || CASE page_id % 3 WHEN 1 THEN 'https://www.profesia.sk/praca/firma/O' || (20000 + page_id) ELSE url END, '{keys.OFFER_NUMBER}', 1), '') AS number FROM pages")
def x08(t):
    p = F.col("page_id")
    own = F.when(p % 3 == 0, F.concat(F.lit("profesia:"), (p + 10000).cast("string"))).when(p % 3 == 1, "x").otherwise("")
    url = F.when(p % 3 == 1, F.concat(F.lit("https://www.profesia.sk/praca/firma/O"), (p + 20000).cast("string"))).otherwise(F.col("url"))
    return t("pages").select("page_id", keys.offer_number(own, url).alias("number"))


_URL = "url || CASE page_id % 4 WHEN 0 THEN '?utm_source=a&id=5&source=x' WHEN 1 THEN '/sk-SK/job/?register=1#top' WHEN 2 THEN '//' ELSE '' END"


def _url():
    p = F.col("page_id")
    return F.concat("url", F.when(p % 4 == 0, "?utm_source=a&id=5&source=x").when(p % 4 == 1, "/sk-SK/job/?register=1#top").when(p % 4 == 2, "//").otherwise(""))


@R.add("x09_clean_address", "SELECT page_id, " + _chain(f"lower(regexp_replace({_URL}, '#.*$', ''))", (r"^https?://(www\.)?", ""), (keys.SESSION, r"\1"), ("&{2,}", "&"), (r"\?&", "?"), ("[?&]+$", ""), ("/+$", "")) + " AS address FROM pages")
def x09(t):
    return t("pages").select("page_id", keys.clean_address(_url()).alias("address"))


_LINK = _chain(f"lower({_URL})", (r"^https?://(www\.)?", ""), ("#.*$", ""), ("^([^/]+)/[a-z]{2}-[a-z]{2}/", r"\1/"), ("/+$", ""))


@R.add("x10_link_key", f"SELECT page_id, {_LINK} AS link FROM pages")
def x10(t):
    return t("pages").select("page_id", keys.link_key(_url()).alias("link"))


_HOST = r"split_part(split_part(regexp_replace(lower(url), '^https?://(www\.)?', ''), '/', 1), '?', 1)"


@R.add("x11_host", f"SELECT page_id, {_HOST} AS host FROM pages")
def x11(t):
    return t("pages").select("page_id", keys.host(F.col("url")).alias("host"))


@R.add("x12_copy_suffix", "SELECT page_id, regexp_replace('R-' || page_id || CASE WHEN page_id % 2 = 0 THEN '-3' ELSE 'x' END, '-[0-9]+$', '') AS id FROM pages")
def x12(t):
    return t("pages").select("page_id", keys.without_copy_suffix(F.concat(F.lit("R-"), "page_id", F.when(F.col("page_id") % 2 == 0, "-3").otherwise("x"))).alias("id"))


_SLUG = _chain(f"lower(translate(text || ' ' || CASE doc_id % 3 WHEN 0 THEN 'spol. s r.o.' WHEN 1 THEN 'GmbH' ELSE 'a. s.' END, '{keys.SLUG_FROM}', '{keys.SLUG_TO}'))", ("[^a-z0-9]+", "-"), ("^-+|-+$", ""), (keys.LEGAL_END, ""))


@R.add("x13_name_slug", f"SELECT doc_id, {_SLUG} AS slug FROM documents")
def x13(t):
    legal = F.when(F.col("doc_id") % 3 == 0, "spol. s r.o.").when(F.col("doc_id") % 3 == 1, "GmbH").otherwise("a. s.")
    return t("documents").select("doc_id", keys.name_slug(F.concat_ws(" ", _line(), legal)).alias("slug"))


_PARTS = f"string_split({_HOST}, '.')"


@R.add("x14_registrable", f"SELECT page_id, CASE WHEN len(p) <= 2 THEN array_to_string(p, '.') WHEN p[-2] IN {keys.SECOND_LEVEL} THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM (SELECT page_id, {_PARTS} AS p FROM pages)")
def x14(t):
    return t("pages").select("page_id", keys.registrable(keys.host(F.col("url"))).alias("domain"))


@R.add("x17_labelled_numbers", r"SELECT page_id, list_distinct(list_transform(regexp_extract_all('IČO: ' || (1234500 + page_id) || ', ico ' || page_id || ' Ico 87654321 ' || url, '(?i)\b(?:ič?o|company id)\s*[:.]?\s*([0-9]{5,8})\b', 1), lambda x: lpad(x, 8, '0'))) AS numbers FROM pages")
def x17(t):
    text = F.concat(F.lit("IČO: "), (F.col("page_id") + 1234500).cast("string"), F.lit(", ico "), F.col("page_id").cast("string"), F.lit(" Ico 87654321 "), F.col("url"))
    return t("pages").select("page_id", keys.labelled_numbers(text).alias("numbers"))


@R.add("x19_web_url", r"SELECT page_id, regexp_matches(CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'mailto:a@b.c' ELSE 'https://user@host/x' END, '^(?i:https?)://[^/?#@\s]+([/?#]\S*)?$') AS ok FROM pages")
def x19(t):
    return t("pages").select("page_id", keys.is_web_url(F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, "mailto:a@b.c").otherwise("https://user@host/x")).alias("ok"))


_LINKS = ["https://boards.greenhouse.io/acme/jobs/1", "https://acme.wd3.myworkdayjobs.com/en-US/Careers/job/x", "https://careers.smartrecruiters.com/Acme", "https://acme.jobs.personio.de/?x=1", "https://acme.nalgoo.com/sk", "https://example.org/careers"]
_BOARD = "CASE " + " ".join(f"WHEN regexp_matches(u, '{p}') THEN '{n}:' || lower(" + " || '/' || ".join(f"regexp_extract(u, '{p}', {g})" for g in gs) + ")" for n, p, gs in keys.BOARDS) + " END"


@R.add("x20_boards", f"SELECT s_suppkey, {_BOARD} AS board FROM (SELECT s_suppkey, ({_LINKS!r})[1 + s_suppkey % {len(_LINKS)}] AS u FROM supplier)")
def x20(t):
    url = F.get(F.array(*map(F.lit, _LINKS)), (F.col("s_suppkey") % len(_LINKS)).cast("int"))
    b = keys.board(url)
    return t("supplier").select("s_suppkey", F.when(b.isNotNull(), F.concat_ws(":", b["provider"], b["board"])).alias("board"))


@R.add("x27_canonical_query", r"SELECT doc_id, CASE WHEN length(q) BETWEEN 2 AND 100 THEN q END AS query FROM (SELECT doc_id, lower(trim(regexp_replace('  ' || text, '\s+', ' ', 'g'))) AS q FROM documents)")
def x27(t):
    return t("documents").select("doc_id", keys.canonical_query(F.concat(F.lit("  "), _line())).alias("query"))


@R.add("d03_local_time_due", "SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Bratislava')::TIMESTAMP AS local_ts, isodow(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Bratislava') <= 5 AND hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Bratislava') >= 8 AS due FROM events")
def d03(t):
    local = scalars.local_time(F.col("ts").cast("timestamp"), F.lit("Europe/Bratislava"))
    e = t("events").select("event_id", local.alias("l"))
    return e.select("event_id", F.col("l").cast("timestamp_ntz").alias("local_ts"), ((F.expr("extract(dayofweek_iso FROM l)") <= 5) & (F.hour("l") >= 8)).alias("due"))


@R.add("d04_zone_day_bounds", "SELECT strftime((ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Bratislava'), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def d04(t):
    day = scalars.local_time(F.col("ts").cast("timestamp"), F.lit("Europe/Bratislava")).cast("date")
    begin, end = scalars.day_bounds(F.col("day"), "Europe/Bratislava")
    days = t("events").select(day.alias("day")).distinct().select("day", begin.alias("b"), end.alias("e"))
    e = t("events").select(F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("near", F.explode(F.array(F.date_sub(F.col("ts").cast("date"), 1), F.col("ts").cast("date"), F.date_add(F.col("ts").cast("date"), 1))))
    hit = e.join(days, e["near"] == days["day"]).where((F.col("ts") >= F.col("b")) & (F.col("ts") < F.col("e")))
    return hit.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@R.add("d05_iso_prefix", "SELECT event_id, strftime(try_cast(nullif(regexp_extract(x, '^\\s*(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE), '%Y-%m-%d') AS day FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN '2024-02-31T00:00' ELSE 'soon' END AS x FROM events)")
def d05(t):
    x = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, "2024-02-31T00:00").otherwise("soon")
    return t("events").select("event_id", F.date_format(scalars.iso_date(x), "yyyy-MM-dd").alias("day"))


@R.add("d07_relative_date", "SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN DATE '2024-03-01' WHEN 1 THEN DATE '2024-02-29' WHEN 2 THEN DATE '2024-03-01' - CAST(event_id % 25 AS INT) END, '%Y-%m-%d') AS day FROM events")
def d07(t):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, "Posted Today").when(e % 4 == 1, "Posted Yesterday").when(e % 4 == 2, F.concat(F.lit("Posted "), (e % 25).cast("string"), F.lit(" Days Ago"))).otherwise("Posted 30+ Days Ago")
    return t("events").select("event_id", F.date_format(scalars.relative_date(text, F.lit("2024-03-01").cast("date")), "yyyy-MM-dd").alias("day"))


@R.add("d10_backoff", "SELECT l_linenumber, least(600.0, 5.0 * pow(2.0, l_linenumber)) AS seconds, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def d10(t):
    return t("lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n")).withColumn("seconds", scalars.backoff(5, 600, F.col("l_linenumber")))


@R.add("d11_rotation", "SELECT p_size, CASE WHEN p_size > 0 THEN (19000 * 7) % p_size END AS first FROM part GROUP BY p_size")
def d11(t):
    return t("part").groupBy("p_size").agg(F.max("p_size").alias("n")).select("p_size", scalars.rotation(F.lit(19000), 7, F.col("n")).alias("first"))


@R.add("a02_split_list", "SELECT source, list_filter(string_split(CASE WHEN source = 'src0' THEN '' ELSE source || ',' || lang END, ','), lambda x: x <> '') AS parts FROM documents GROUP BY source, lang")
def a02(t):
    text = F.when(F.col("source") == "src0", "").otherwise(F.concat_ws(",", "source", "lang"))
    return t("documents").select("source", "lang").distinct().select("source", scalars.split_list(text).alias("parts"))


@R.add("n01_json_paths", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) FILTER (json_exists(props, '$.k')) AS has FROM events GROUP BY event_type")
def n01(t):
    k = F.get_json_object("props", "$.k")
    return t("events").groupBy("event_type").agg(F.sum(k.cast("long")).alias("total"), F.count_if(k.isNotNull()).alias("has"))


@R.add("h01_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def h01(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@R.add("m02_dot_and_norm", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square FROM embeddings")
def m02(t):
    return t("embeddings").select("vec_id", F.round(scalars.dot(F.col("embedding"), F.col("embedding")), 6).alias("square"))


DICTIONARY = positions.Dictionary(
    (
        positions.Position("ALPHA", titles=("the of",), roles=("the", "der"), keywords=("and", "und"), exclude=("is the",)),
        positions.Position("BETA", titles=("de la",), roles=("le", "la"), keywords=("que",)),
    ),
    content_hits=4,
    other=("scum",),
)
_W = r"(^|[^a-z0-9+#])"


def _p02_sql() -> str:
    has = lambda col, w: f"regexp_matches({col}, '(^|[^\\p{{L}}\\p{{N}}+#]){w}($|[^\\p{{L}}\\p{{N}}+#.]|\\.($|[^\\p{{L}}\\p{{N}}]))')"
    count = lambda w: f"len(list_filter(string_split(b, ' '), lambda x: regexp_matches(x, '^([^\\p{{L}}\\p{{N}}+#]*){w}(\\.?[^\\p{{L}}\\p{{N}}+#.]*)$')))"
    special = " OR ".join(has("h", w) for w in ("scum", "and", "und", "que"))
    one = lambda code, ex, own, role, key: f"SELECT doc_id, '{code}' AS code FROM x WHERE NOT ({ex}) AND ({own} OR ({role}) AND ({key[0]} OR NOT ({special}) AND ({key[1]})))"
    t = "strip_accents(lower(text))"
    h = "regexp_replace(strip_accents(lower(split_part(text, chr(10), 1))), '[-/|,()\\[\\]:;]+', ' ', 'g')"
    b = f"regexp_replace(regexp_replace({t}, '[-/|,()\\[\\]:;]+', ' ', 'g'), '\\s', ' ', 'g')"
    return f"WITH x AS (SELECT doc_id, {h} AS h, {b} AS b FROM documents) " + " UNION ALL ".join(
        [
            one("ALPHA", has("h", "is the"), has("h", "the of"), f"{has('h', 'the')} OR {has('h', 'der')}", (f"{has('h', 'and')} OR {has('h', 'und')}", f"{count('and')} >= 4 OR {count('und')} >= 4")),
            one("BETA", "false", has("h", "de la"), f"{has('h', 'le')} OR {has('h', 'la')}", (has("h", "que"), f"{count('que')} >= 4")),
        ]
    )


@R.add("p02_position_match", _p02_sql())
def p02(t):
    d = t("documents").select("doc_id", positions.normal(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("h"), positions.normal(F.col("text")).alias("b"))
    return d.select("doc_id", F.explode(positions.matches(DICTIONARY, F.col("h"), F.col("b"))).alias("m")).select("doc_id", "m.code")


_MARK = "CASE doc_id % 7 WHEN 0 THEN 'Remote developer' WHEN 1 THEN 'Hybrid role' WHEN 2 THEN 'On site' WHEN 3 THEN 'Remote, on site' WHEN 4 THEN 'Home office' ELSE '' END"


@R.add("p06_work_format", f"""WITH x AS (SELECT doc_id, regexp_replace(lower({_MARK}), '[-/|,()\\[\\]:;]+', ' ', 'g') AS m FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(m, '{locations.HYBRID}') THEN 'HYBRID' WHEN regexp_matches(m, '{locations.REMOTE_WORDS}') AND regexp_matches(m, '{locations.OFFICE}') THEN 'CONFLICT'
  WHEN regexp_matches(m, '{locations.REMOTE_WORDS}') THEN 'REMOTE' WHEN regexp_matches(m, '{locations.OFFICE}') THEN 'OFFICE' END AS format FROM x""")
def p06(t):
    d = F.col("doc_id")
    marks = F.when(d % 7 == 0, "Remote developer").when(d % 7 == 1, "Hybrid role").when(d % 7 == 2, "On site").when(d % 7 == 3, "Remote, on site").when(d % 7 == 4, "Home office").otherwise("")
    return t("documents").select("doc_id", locations.work_format(positions.normal(marks), F.lit("")).alias("format"))


_WHERE = ["Bratislava, Slovakia", "Remote - EU", "SVK.Bratislava", "IND - Hyderabad (Telangana)", "Wien | Praha", "2 Locations", ""]
_EU = "['AT', 'BE', 'BG', 'CY', 'CZ', 'DE', 'DK', 'EE', 'ES', 'FI', 'FR', 'GR', 'HR', 'HU', 'IE', 'IT', 'LT', 'LU', 'LV', 'MT', 'NL', 'PL', 'PT', 'RO', 'SE', 'SI', 'SK']"
#: What the rules give for the places of _WHERE; the name, which names a home city, decides where no place does.
_P04 = f"""SELECT c_custkey, v.countries FROM customer JOIN (VALUES (0, ['SK']), (1, {_EU}), (2, ['SK']), (3, ['IN']), (4, ['AT', 'CZ']), (5, ['SK']), (6, ['SK'])) v(i, countries) ON v.i = c_custkey % 7"""


@R.add("p04_place_countries", _P04)
def p04(t):
    where = F.array(F.get(F.array(*map(F.lit, _WHERE)), (F.col("c_custkey") % len(_WHERE)).cast("int")))
    resolve = locations.countries({"bratislava": "SK", "hyderabad": "IN", "wien": "AT", "praha": "CZ"}, {"kosice": "SK"})
    return t("customer").select("c_custkey", resolve(where, F.concat(F.lit("Tester Košice "), "c_name"), F.lit(None).cast("string")).alias("countries"))


@R.add("p08_language_requirements", "SELECT doc_id, v.language, v.required FROM documents JOIN (VALUES (0, 'en', true), (0, 'de', false), (1, 'en', true), (2, 'de', false), (3, NULL, NULL)) v(i, language, required) ON v.i = doc_id % 4")
def p08(t):
    said = ["Fluent English required. German is a plus.", "<p>anglický jazyk – pokročilý</p>", "Deutsch von Vorteil", "Nice place, French food"]
    html = F.concat(F.get(F.array(*map(F.lit, said)), (F.col("doc_id") % 4).cast("int")), F.lit("<br>"), F.col("text"))
    return t("documents").select("doc_id", F.explode_outer(languages.language_requirements(html)).alias("r")).select("doc_id", "r.language", "r.required")


def _turn(x: str) -> str:
    x = rf"regexp_replace({x}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<[a-zA-Z/!][^>]*>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@R.add("p16_html_text", rf"SELECT page_id, trim(regexp_replace({_turn(_turn('html'))}, '\s+', ' ', 'g')) AS text FROM pages")
def p16(t):
    return t("pages").select("page_id", scalars.html_text(F.col("html")).alias("text"))


_V02 = f"""WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id AS example, label AS code, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.id, e.example, e.code, list_inner_product(q.v, e.v) AS s FROM q, e WHERE q.id <> e.example), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, example) AS r FROM p),
n AS (SELECT id, code, round(sum(s), 9) AS votes, min(r) AS nearest, max(s) AS top FROM r WHERE r <= {neighbours.K} GROUP BY id, code)
SELECT id, code FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, nearest) AS k, max(top) OVER (PARTITION BY id) AS best FROM n) WHERE k = 1 AND best >= 0.3"""


@R.add("v02_knn_vote", _V02)
def v02(t):
    e = t("embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.vote_all(queries, e.select(F.col("vec_id").alias("example"), F.col("label").alias("code"), F.col("embedding").alias("vector")), least=0.3, own=False)
