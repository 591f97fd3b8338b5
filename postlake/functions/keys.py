"""Comparison keys of titles, employers and addresses, as native Column expressions.

All keys are total: null input gives null (or the key of the empty string where said so), and
nothing is cast, so no input fails.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets of the keys. Four tables differ on purpose; results depend on each.
SEARCH_FROM, SEARCH_TO = "áäčďéíĺľňóôöŕšťúüýž", "aacdeillnooorstuuyz"
HEAD_FROM, HEAD_TO = "áäčďéíĺľňóôŕšťúýž", "aacdeillnoorstuyz"
TITLE_FROM, TITLE_TO = "áäčďéěíĺľňóôŕřšťúůýžÁÄČĎÉĚÍĹĽŇÓÔŔŘŠŤÚŮÝŽ", "aacdeeillnoorrstuuyzaacdeeillnoorrstuuyz"
TEXT_FROM = "абвгґдезиійклмнопрстуфыэ" + "áäčďéěíĺľňóôŕřšťúůýž" + "àâãåçèêëìîïñòõöøùûüÿąćęłńśźżőű"
TEXT_TO = "abvggdeziiyklmnoprstufye" + "aacdeeillnoorrstuuyz" + "aaaaceeeiiinoooouuuyacelnszzou"
CYRILLIC = (("щ", "shch"), ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("ю", "yu"), ("я", "ya"), ("є", "ye"), ("ї", "yi"), ("ё", "e"), ("ь", ""), ("ъ", ""))
SLUG_FROM = "áäàâãåčćçďéěëèêíìîïĺľłňńñóôöòõőŕřšśťúůüùûűýÿžźżÁÄÀÂÃÅČĆÇĎÉĚËÈÊÍÌÎÏĹĽŁŇŃÑÓÔÖÒÕŐŔŘŠŚŤÚŮÜÙÛŰÝŸŽŹŻ"
SLUG_TO = "aaaaaacccdeeeeeiiiilllnnnoooooorrsstuuuuuuyyzzzaaaaaacccdeeeeeiiiilllnnnoooooorrsstuuuuuuyyzzz"
# Patterns of what titles carry beside the position, and of legal forms.
SALARY = r"(\bod\s+)?\d[\d .,]*(\s*-\s*\d[\d .,]*)?(,\s*-)?\s*(€|\beur\b)(\s*/\s*[a-z]+\.?)?(\s*(brutto|netto)\b)?"
EURO_FIRST = r"(€|\beur\b)\s*\d[\d .,]*"
GENDER = r"\b(muz|zena|m|z|f|w|d)(\s*/\s*(muz|zena|m|z|f|w|d))+\b"
LEGAL_PAREN = r"\([^)]*\b(s\s*\.?\s*r\s*\.?\s*o|a\s*\.?\s*s|spol|k\s*\.?\s*s|v\s*\.?\s*o\s*\.?\s*s|gmbh|ltd|inc)\b[^)]*\)"
LEGAL_END = r"(-(spol-s-r-o|s-r-o|sro|a-s|as|k-s|v-o-s|s-e|se|j-s-a|v-d|druzstvo|o-z|organizacna-zlozka|odstepny-zavod|gmbh|ag|ltd|inc|kft|sp-z-o-o))+$"
OFFER_NUMBER = r"(?:profesia:|profesia\.sk/(?:[^ ]*/)?O)([0-9]{5,})"
SESSION = r"([?&])(search_id|utm_[a-z_]*|source|source_id|register)=[^&]*"
LISTED_SESSION = r"([?&])(?:search_id|utm_[a-z_]+|filter)=[^&#]*"
#: Second-level labels under which names are registered.
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac", "gob", "or", "ne")


def fold(text: Column) -> Column:
    """Search text: lower case without Slovak, Czech and German marks."""
    return F.translate(F.lower(text), SEARCH_FROM, SEARCH_TO)


def title_head(title: Column) -> Column:
    """A title up to its first separator, lower-cased, without marks and surplus spaces."""
    cut = F.regexp_replace(F.translate(F.lower(title), HEAD_FROM, HEAD_TO), r"(?s)\s*([|,/(–]|\s-\s).*$", "")
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def _where(text: Column, holds: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """text, changed if it holds what the change looks for; it is computed once, though asked twice."""
    return F.get(F.transform(F.array(text), lambda x: F.when(holds(x), change(x)).otherwise(x)), F.lit(0))


def _blanked(text: Column, *patterns: str) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, " "), patterns, text)


def _bare(text: Column) -> Column:
    # a look at the first letter spares the pattern at most places; whole texts stand for titles too
    text = _where(text, lambda x: F.contains(x, F.lit("€")) | F.contains(x, F.lit("eur")), lambda x: _blanked(x, r"(?=[o\d])" + SALARY, "(?=[€e])" + EURO_FIRST))
    text = _where(text, lambda x: F.contains(x, F.lit("/")), lambda x: _blanked(x, "(?=[mzfwd])" + GENDER))
    return F.trim(_blanked(text, "[^a-z0-9]+"))


def same_title(title: Column) -> Column:
    """Title without anything in parentheses, salary or gender marks; words joined by one space."""
    return _bare(F.regexp_replace(F.lower(F.translate(title, TITLE_FROM, TITLE_TO)), r"\([^)]*\)", " "))


def plain_text(value: Column) -> Column:
    """Lower case, Cyrillic in Latin letters, no marks; null as empty."""
    out = F.lower(F.coalesce(value, F.lit("")))
    for a, b in CYRILLIC:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, TEXT_FROM, TEXT_TO)


def title_key(title: Column) -> Column:
    """Identity key of a title: as same_title, but parentheses stay unless they name a legal form."""
    return _bare(F.regexp_replace(plain_text(title), LEGAL_PAREN, " "))


def name_slug(name: Column) -> Column:
    """Company name as in addresses: words joined by hyphens, legal forms at the end dropped."""
    dashed = F.regexp_replace(F.lower(F.translate(name, SLUG_FROM, SLUG_TO)), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "^-+|-+$", ""), LEGAL_END, "")


def offer_number(external_id: Column, url: Column) -> Column:
    """Number of a portal offer, from its id or its address; null if there is none."""
    both = F.concat(F.coalesce(external_id, F.lit("")), F.lit(" "), F.coalesce(url, F.lit("")))
    return F.nullif(F.regexp_extract(both, OFFER_NUMBER, 1), F.lit(""))


def _no_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"^https?://(www\.)?", "")


def clean_address(url: Column) -> Column:
    """Address without scheme, www., fragment, session parameters and trailing slashes; null as empty."""
    out = _no_scheme(F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")))
    for pattern, new in ((SESSION, "$1"), ("&{2,}", "&"), (r"\?&", "?"), ("[?&]+$", ""), ("/+$", "")):
        out = F.regexp_replace(out, pattern, new)
    return out


def without_session(url: Column) -> Column:
    """Address of a listed posting without what changes between visits (a search's number, campaign marks, a list's filter);
    other parameters and the fragment stay. Where several go before the first that stays, one & stays behind the ?, as ids
    on record have it. Null stays null."""
    out = F.replace(F.regexp_replace(url, LISTED_SESSION, "$1"), F.lit("?&"), F.lit("?"))
    return F.regexp_replace(F.regexp_replace(out, "&{2,}", "&"), r"[?&]+(#(?s:.*))?\z", "$1")


def link_key(url: Column) -> Column:
    """Employer link: as an address, but parameters stay and a language folder after the host goes."""
    out = F.regexp_replace(_no_scheme(F.lower(url)), "#.*$", "")
    return F.regexp_replace(F.regexp_replace(out, "^([^/]+)/[a-z]{2}-[a-z]{2}/", "$1/"), "/+$", "")


def host(url: Column) -> Column:
    """Host of an address, lower case, without www."""
    return F.split_part(F.split_part(_no_scheme(F.lower(url)), F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))


def registrable(name: Column) -> Column:
    """Registered domain of a host: two labels, three below a second-level label."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    three = (n >= 3) & F.get(parts, n - 2).isin(*SECOND_LEVEL)
    return F.when(n <= 2, name).otherwise(F.array_join(F.slice(parts, F.when(three, n - 2).otherwise(n - 1), F.lit(3)), "."))


def without_copy_suffix(external_id: Column) -> Column:
    """Board id without the -N that a board adds to copies."""
    return F.regexp_replace(external_id, "-[0-9]+$", "")


def is_web_url(url: Column) -> Column:
    """http(s) with a host and no user part."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#@\s]+([/?#]\S*)?$"), F.lit(False))


# Address patterns of hiring systems; groups make the board.
BOARDS = (
    ("GREENHOUSE", r"(?i)^https?://(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_-]+)", (1,)),
    ("WORKDAY", r"(?i)^https?://([a-z0-9-]+\.wd[0-9]+)\.myworkdayjobs\.com/(?:[a-z]{2}-[a-z]{2}/)?([a-z0-9_-]+)", (1, 2)),
    ("SMARTRECRUITERS", r"(?i)^https?://(?:careers|jobs)\.smartrecruiters\.com/([a-z0-9_-]+)", (1,)),
    ("PERSONIO", r"(?i)^https?://([a-z0-9-]+)\.jobs\.personio\.(?:de|com)", (1,)),
    ("NALGOO", r"(?i)^https?://([a-z0-9-]+)\.nalgoo\.com", (1,)),
    ("ORACLE", r"(?i)^https?://([a-z0-9.-]+\.oraclecloud\.com)/hcmUI/CandidateExperience/[a-z-]+/sites/([a-z0-9_-]+)", (1, 2)),
)


def board(url: Column) -> Column:
    """struct(provider, board) of a hiring system's address, null for any other."""
    out = F.lit(None).cast("struct<provider:string,board:string>")
    for provider, pattern, groups in reversed(BOARDS):
        name = F.lower(F.concat_ws("/", *[F.regexp_extract(url, pattern, g) for g in groups]))
        out = F.when(url.rlike(pattern), F.struct(F.lit(provider).alias("provider"), name.alias("board"))).otherwise(out)
    return out


# What tells the career sites of four systems apart in their pages' text, scripts included.
SUCCESS_FACTORS_CDN, NALGOO_API, PHENOM_CDN = "rmkcdn.successfactors.com", "ats.nalgoo.com/api", "cdn.phenompeople.com"
NALGOO_NAME = r"""(?i)\\?"organization\\?"\s*:\s*\\?"([a-z0-9-]+)"""
PHENOM_BASE = r"""(?i)"baseUrl"\s*:\s*"https?://([a-z0-9.-]+\.[a-z]+(?:/[a-z0-9_-]+)*)/?\""""
TALEO = r"(?i)(?<![a-z0-9-])([a-z0-9-]+\.taleo\.net)/careersection/([a-z0-9_]+)/(?:jobsearch|jobdetail|moresearch)\.ftl"
HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


def boards_in_page(page: Column, html: Column) -> Column:
    """Distinct struct(provider, board) of the hiring systems that a page is a site of, or names in links and scripts; page is its address.

    Slashes that scripts escape are read as such. Null pages and such without boards give an empty array."""
    text = F.replace(F.coalesce(html, F.lit("")), F.lit("\\/"), F.lit("/"))
    one = lambda provider, name: F.struct(F.lit(provider).alias("provider"), F.nullif(F.lower(name), F.lit("")).alias("board"))
    sites = F.array(
        F.when(F.contains(text, F.lit(SUCCESS_FACTORS_CDN)), one("SUCCESSFACTORS", host(page))),
        F.when(F.contains(text, F.lit(NALGOO_API)), one("NALGOO", F.regexp_extract(text, NALGOO_NAME, 1))),
        F.when(F.contains(text, F.lit(PHENOM_CDN)), one("PHENOM", F.regexp_extract(text, PHENOM_BASE, 1))),
    )
    found = lambda group: F.regexp_extract_all(text, F.lit(TALEO), F.lit(group))
    taleo = F.zip_with(found(1), found(2), lambda a, b: one("TALEO", F.concat_ws("/", a, b)))
    linked = F.transform(F.regexp_extract_all(text, F.lit(HREF), F.lit(1)), board)
    return F.array_distinct(F.filter(F.concat(sites, taleo, linked), lambda x: x["board"].isNotNull()))


def labelled_numbers(text: Column, label: str = r"(?:ič?o|company id)") -> Column:
    """Array of 5-8 digit numbers behind a label, padded to 8 digits."""
    found = F.regexp_extract_all(text, F.lit(rf"(?iu)\b{label}\s*[:.]?\s*([0-9]{{5,8}})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lpad(x, 8, "0")))


def canonical_query(text: Column) -> Column:
    """A search text as it is counted: trimmed, single spaces, lower case; null unless 2 to 100 characters."""
    out = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(F.length(out).between(2, 100), out)


def percent_decoded(text: Column) -> Column:
    """Percent-decoded text; text with a sequence that can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(text), text)
