"""Countries and work format of a posting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.matching.positions import plain_text

#: Shortest beginning of a piece that is looked up, most words of a city in a text.
MIN_PREFIX, MAX_WORDS = 4, 4
# Words of remote and office work in normalised text; regions of remote work.
REMOTE_WORDS = r"\b(fully remote|remote first|remote|work from home|home office|praca z domu|na dialku)\b"
REMOTE_TEXT = r"\b(fully remote|100% remote|remote position|remote work|work from home|praca z domu|praca na dialku)\b"
HYBRID = r"\bhybrid\w*\b"
OFFICE = r"\b(on site|onsite|in office|office based|in the office|v kancelarii|prezencne)\b"
ALIASES = {"usa": "US", "us": "US", "uk": "GB", "england": "GB", "great britain": "GB", "czech republic": "CZ", "slovak republic": "SK", "holland": "NL", "south korea": "KR", "uae": "AE"}
EU = "AT BE BG HR CY CZ DK EE FI FR DE GR HU IE IT LV LT LU MT NL PL PT RO SK SI ES SE".split()
EEA = [*EU, *"IS LI NO".split()]
EUROPE = [*EEA, *"CH GB AL BA ME MK RS MD UA".split()]
REGIONS = {
    "eu": EU,
    "european union": EU,
    "eea": EEA,
    "europe": EUROPE,
    "emea": [*EUROPE, *"TR IL AE SA EG ZA MA NG KE".split()],
    "cee": "BG HR CZ EE HU LV LT PL RO SK SI RS BA ME MK AL UA MD".split(),
    "central europe": "AT CZ DE HU PL SK SI CH".split(),
    "dach": "DE AT CH".split(),
    "nordics": "DK FI IS NO SE".split(),
    "benelux": "BE NL LU".split(),
    "worldwide": ["*"],
    "anywhere": ["*"],
    "global": ["*"],
}
# Names of countries in English, German and Slovak, and three-letter codes. The table
# covers the countries of the regions above that the fixtures use; more may be passed.
COUNTRIES = {
    "slovakia": "SK", "slowakei": "SK", "slovensko": "SK", "czechia": "CZ", "tschechien": "CZ", "cesko": "CZ",
    "hungary": "HU", "ungarn": "HU", "madarsko": "HU", "poland": "PL", "polen": "PL", "polsko": "PL",
    "austria": "AT", "osterreich": "AT", "rakusko": "AT", "germany": "DE", "deutschland": "DE", "nemecko": "DE",
    "france": "FR", "frankreich": "FR", "francuzsko": "FR", "spain": "ES", "spanien": "ES", "spanielsko": "ES",
    "india": "IN", "indien": "IN", "united states": "US", "vereinigte staaten": "US", "spojene staty": "US",
    "united kingdom": "GB", "vereinigtes konigreich": "GB", "spojene kralovstvo": "GB", "romania": "RO", "italy": "IT",
}
ISO3 = {"SVK": "SK", "CZE": "CZ", "HUN": "HU", "POL": "PL", "AUT": "AT", "DEU": "DE", "FRA": "FR", "ESP": "ES", "IND": "IN", "USA": "US", "GBR": "GB", "ROU": "RO", "ITA": "IT"}


def work_format(marks: Column, text: Column) -> Column:
    """HYBRID, CONFLICT, REMOTE, OFFICE or null, of normalised title and places, and text."""
    remote = marks.rlike(REMOTE_WORDS) | text.rlike(REMOTE_TEXT)
    office = marks.rlike(OFFICE)
    return (
        F.when(marks.rlike(HYBRID) | text.rlike(HYBRID), "HYBRID")
        .when(remote & (office | text.rlike(OFFICE)), "CONFLICT")
        .when(remote, "REMOTE")
        .when(office, "OFFICE")
    )


class Places:
    """Names to countries: countries and aliases first, then regions, then cities."""

    def __init__(self, cities: dict[str, str], countries: dict[str, str] | None = None):
        self.cities, self.countries = cities, {**(countries or COUNTRIES), **ALIASES}

    def _named(self, name: str) -> list[str]:
        if name in self.countries:
            return [self.countries[name]]
        return REGIONS.get(name) or ([self.cities[name]] if name in self.cities else [])

    def _piece(self, piece: str) -> list[str]:
        code = re.match(r"([A-Z]{3})\.", piece.strip())
        if code and code[1] in ISO3:
            return [ISO3[code[1]]]
        words = re.sub(REMOTE_WORDS, " ", plain_text(piece)).split()
        for n in range(len(words), 0, -1):
            start = " ".join(words[:n])
            if (n == len(words) or len(start) >= MIN_PREFIX) and (found := self._named(start)):
                return found
        return []

    def countries_of(self, locations: list[str | None]) -> list[str]:
        """Sorted countries of all places of a posting."""
        out: set[str] = set()
        for location in locations:
            for place in re.split(r"[;|/]| or ", location or ""):
                for segment in place.split(","):
                    for piece in re.split(r"\s+[-‐-―]\s+|[()_]", segment):
                        out.update(self._piece(piece))
        return sorted(out)

    def home(self, title: str | None, locations: list[str | None]) -> list[str]:
        """Sorted countries of the cities that are whole words of title or places."""
        words = re.split(r"[\W_]+", plain_text(" ".join([title or "", *(x or "" for x in locations)])).strip())
        out = {self.cities.get(" ".join(words[i : i + n])) for i in range(len(words)) for n in range(1, MAX_WORDS + 1) if i + n <= len(words)}
        return sorted(x for x in out if x)


def countries(cities: dict[str, str], home_cities: dict[str, str] | None = None):
    """A vectorised function (locations array, title, portal country) -> array of countries: by
    places, else the portal's country, else that of home cities. cities is a bounded dictionary
    (names of at least half a million people and those of one country)."""
    places, home = Places(cities), Places(home_cities or {})

    @F.pandas_udf("array<string>")
    def resolve(locations: pd.Series, title: pd.Series, portal: pd.Series) -> pd.Series:
        out = []
        for where, name, own in zip(locations, title, portal, strict=True):
            where = list(where) if where is not None else []
            out.append(places.countries_of(where) or ([own] if own else home.home(name, where)))
        return pd.Series(out)

    return resolve
