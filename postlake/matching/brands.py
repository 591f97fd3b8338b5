"""Brands in company names, and whether a site is that of a company.

Names are short and their grammar is sequential (initials, titles, inner dots), so brands are made
by one vectorised function; everything about hosts and flags is native.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms, titles, words that are no brand, zones that end a brand's domain.
LEGAL = r"\b(s\.?\s?r\.?\s?o\.?|a\.?\s?s\.?|spol\.?\s*s\s*r\.?\s?o\.?|v\.?\s?o\.?\s?s\.?|k\.?\s?s\.?|se|organizacna zlozka.*|pobocka.*|slovenska republika|slovakia|slovensko|sr|spolocnost s rucenim obmedzenym|akciova spolocnost)\b"
TITLES = frozenset("ing mgr mudr mvdr mddr judr phdr rndr paeddr bc dr doc prof phd".split())
SKIPPED = frozenset(("a", "the", "and"))
ZONES = frozenset("sk com cz eu net org info biz".split())
GENERIC = frozenset(
    """obec mesto mestska skola zakladna stredna spojena gymnazium materska sukromna senior seniori centrum technicka technicke
    euro eko agro stav stavby servis sluzby domov nemocnica klub group trade invest energy auto transport logistics logistika
    consulting system systems tech media plus slovak slovensko slovakia sk sr union global service services company spolocnost
    druzstvo podnik farma market obchod real reality smart green best top super slovenske holding stores""".split()
)
PARKED = r"(?iu)domain (is )?for sale|dom[eé]na je na predaj|buy this domain|parked|hugedomains|sedo\.com|afternic|dan\.com|godaddy|domain_profile"
SLOVAK = r"(?iu)slovensk|\bslovakia\b|\bslovak republic\b"
MARKETS = ("sedo.com", "dan.com", "afternic.com", "hugedomains.com")
#: Fewest words of a page that says anything; brands up to so many letters must be in the title too.
MIN_WORDS, SHORT = 30, 3
GROUP_LETTERS = 4


def _ascii(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()


def _pieces(name: str) -> Iterator[str]:
    """Words of a name that may be a brand, in order."""
    for word in re.split(r"[^a-z0-9.]+", re.sub(LEGAL, " ", _ascii(name))):
        bare = word.strip(".")
        if not bare or word in SKIPPED or word.endswith(".sk"):
            continue
        labels = bare.split(".")
        if len(labels) == 1:
            yield bare
        elif labels[-1] in ZONES:
            yield labels[0]
        elif min(map(len, labels)) >= 2:
            yield "".join(labels)  # others are initials


def name_words(name: str | None) -> list[str]:
    """Brand words; letters that stand alone in a row are one word."""
    marked = " ".join(_pieces(name or ""))
    return re.sub(r"\b([a-z])((?: [a-z]\b)+)", lambda m: m[0].replace(" ", ""), marked).split()


def brands(name: str | None) -> list[str]:
    """The first word (no title, if more follow), and the first two, joined and hyphenated."""
    words = name_words(name)
    out = words[:1] if len(words) == 1 or words[:1] and words[0] not in TITLES else []
    if len(words) > 1:
        out = [*out, words[0] + words[1], f"{words[0]}-{words[1]}"]
    return [b for b in dict.fromkeys(out) if re.fullmatch("[a-z0-9-]+", b) and len(b.replace("-", "")) > 1]


def keys(name: str | None) -> list[str]:
    """Brands without hyphens that are not generic, alone or as a pair of generic words."""
    words = name_words(name)
    pair = "".join(words[:2]) if len(words) > 1 and GENERIC.issuperset(words[:2]) else None
    return list(dict.fromkeys(k for b in brands(name) if b not in GENERIC and (k := b.replace("-", "")) != pair))


def addresses(name: str | None) -> list[str]:
    """Hosts and paths where a company's site may be."""
    out = [f"www.{w}/" for w in re.split(r"[^a-z0-9.]+", re.sub(LEGAL, " ", _ascii(name or ""))) if w.endswith(".sk") and len(w) > 4 and w not in SKIPPED]
    for b in brands(name):
        out += [f"www.{b}{tail}.sk/" for tail in ("", "-slovakia", "slovakia")]
        out += [f"www.{b}.com/{path}" for path in ("sk/", "slovakia/", "")]
        out += [f"www.{b}{tail}.sk/" for tail in ("slovensko", "-slovensko", "-jobs", "jobs", "-kariera")]
        out.append(f"kariera.{b}.sk/")
    pair = re.match(r"\s*([A-Za-z]+)\s*&\s*([A-Za-z]+)", name or "")
    if pair:
        both = f"{pair[1]}and{pair[2]}".lower()
        out += [f"www.{both}.sk/", f"www.{both}.com/"]
    return list(dict.fromkeys(out))


def _array(function, column: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(names: pd.Series) -> pd.Series:
        return names.map(function)

    return run(column)


def brand_keys(name: Column) -> Column:
    """Array of keys()."""
    return _array(keys, name)


def candidate_addresses(name: Column) -> Column:
    """Array of addresses(), to be exploded."""
    return _array(addresses, name)


def for_sale(host: Column) -> Column:
    """Whether a host is that of a domain market."""
    bare = F.regexp_replace(F.lower(F.trim(host)), r"\.$", "")
    out = F.lit(False)
    for m in MARKETS:
        out = out | (bare == m) | F.endswith(bare, F.lit("." + m))
    return out


def confirmed(name: str | None, host: str, title: str, text: str, html: str) -> bool:
    """Whether a page shows that it is the company's: long enough, not parked, Slovak, a brand both in
    the host and in the text, the second word of the name too, short brands also in the title."""
    plain, head = _ascii(text), _ascii(title)
    if re.search(PARKED, html) or len(plain.split()) < MIN_WORDS:
        return False
    if not host.endswith(".sk") and not re.search(SLOVAK, text):
        return False
    label = host.removeprefix("www.").split(".")[0].replace("-", "")
    has = lambda word, where: re.search(rf"\b{re.escape(word)}\b", where) or re.search(rf"\b{re.escape(word)}\b", re.sub(r"(?<=[a-z])\.(?=[a-z])", "", where))
    found = [b for b in keys(name) if b in label and has(b, plain)]
    words = name_words(name)
    if not found:
        return False
    if len(words) > 1 and words[1] not in GENERIC and found == [words[0].replace("-", "")] and not has(words[1], plain):
        return False
    return len(max(found, key=len)) > SHORT or any(has(b, head) for b in found)


def page_confirmed(name: Column, host: Column, title: Column, text: Column, html: Column) -> Column:
    """confirmed() of each page, in Arrow batches; null texts are empty, a null name or host is never confirmed."""

    @F.pandas_udf("boolean")
    def run(names: pd.Series, hosts: pd.Series, titles: pd.Series, texts: pd.Series, pages: pd.Series) -> pd.Series:
        rows = zip(names, hosts, titles, texts, pages, strict=True)
        return pd.Series([bool(n) and bool(h) and confirmed(n, h, t or "", x or "", p or "") for n, h, t, x, p in rows], dtype=bool)

    return run(name, F.lower(host), title, text, html)


def verdict(opened: Column, failure: Column, on_sale: Column, number_found: Column, brand_found: Column, group_found: Column) -> Column:
    """What a check of a site says: by the failure's kind, else number, brand, group, opened."""
    return (
        F.when(failure == "TEMPORARY", "TEMPORARY")
        .when(failure == "ACCESS_DENIED", "CLOSED")
        .when(failure == "USE_FORBIDDEN", "ROBOTS")
        .when(failure == "TOO_LARGE", "OPENED")
        .when(failure.isNotNull() | ~opened | on_sale, "GONE")
        .when(number_found, "REGISTRATION_NUMBER")
        .when(brand_found, "BRAND")
        .when(group_found, "GROUP")
        .otherwise("OPENED")
    )


# Words of links to openings, of list pages and of forms; hosts of job portals.
CAREER_WORDS = r"(?iu)kari[eé]r|career|\bjobs?\b|\bpr[aá]ca u n[aá]s|vo[ľl]n[ée][ -](?:poz[ií]cie|miesta|pracovn)|pracovn[ée][ -](?:ponuky|poz[ií]cie|miesta)|ponuk[ay][ -]pr[aá]ce|pridaj sa|join us|work with us|zamestnanie|n[aá]bor"
LIST_WORDS = r"(?iu)vo[ľl]n[ée] (?:poz[ií]c|miest|pracovn)|pracovn[ée] (?:ponuk|poz[ií]c|miest)|ponuk[ay] pr[aá]c|ponuka-prace|volne-pozicie|pracovne-ponuky|open positions|job offers|vacanc|all jobs|stellenangebote|pozície"
FORM_WORDS = r"(?iu)[žz]iados[ťt]|formul[aá]r|[žz]ivotopis|\bcv\b|apply|prihl[aá]s|registr|login|spontan"
PORTAL_HOSTS = r"(?i)almacareer|jobs\.cz|prace\.cz|atmoskop|platy\.(?:sk|cz)|teamio|cvonline|hugedomains|sedo|afternic|profesia\.(?:sk|cz)|istp\.sk|sluzbyzamestnanosti|(?:^|\.)(?:kariera|praca|job|dentaljobs)\.sk$"


def link_rank(text_and_address: Column) -> Column:
    """0 for links to a list of openings, 2 for forms, 1 for others."""
    return F.when(text_and_address.rlike(LIST_WORDS), 0).when(text_and_address.rlike(FORM_WORDS), 2).otherwise(1)


def is_career_link(text_and_address: Column) -> Column:
    return text_and_address.rlike(CAREER_WORDS)


def on_portal(host: Column) -> Column:
    """Whether a host is that of a job portal."""
    return host.rlike(PORTAL_HOSTS)


#: Public mail hosts.
MAIL_HOSTS = ("gmail.com", "centrum.sk", "azet.sk", "zoznam.sk", "post.sk", "yahoo.com", "outlook.com", "hotmail.com", "seznam.cz", "icloud.com")


def mail_names_company(domain: str | None, name: str | None) -> bool:
    """Whether a mail host names a company: its initials (3 letters or more) or a word of it that is
    not generic (3 letters or more) are in the domain; public hosts never do."""
    host = (domain or "").lower()
    if not host or host in MAIL_HOSTS:
        return False
    words = name_words(name)
    first = "".join(w[0] for w in words)
    return len(first) > 2 and first in host or any(len(w) > 2 and w not in GENERIC and w in host for w in words)
