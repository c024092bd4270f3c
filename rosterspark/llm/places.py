"""Names of the world's countries in many languages, by rule from the JVM's locale data.

The list holds every ISO country, also those a reference list lacks: a value that means one of them
must not be bent to the nearest listed one.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import SparkSession

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "sv", "nb", "da", "fi", "pl", "cs", "sk", "hu", "ro", "hr", "bs", "tr", "bg", "sr", "uk", "ru", "el", "ga", "vi", "et")

# Fixed values of English: people or adjective of the countries whose reference list is used here, and some beside.
DEMONYMS = {
    "AE": "emirati", "AT": "austrian", "AU": "australian", "BA": "bosnian", "BE": "belgian", "BG": "bulgarian", "CA": "canadian", "CH": "swiss",
    "CI": "ivorian", "CO": "colombian", "CY": "cypriot", "CZ": "czech", "DE": "german", "DK": "danish", "EG": "egyptian", "ES": "spanish",
    "FI": "finnish", "FR": "french", "GB": "british", "GR": "greek", "IE": "irish", "IN": "indian", "IQ": "iraqi", "IR": "iranian",
    "IT": "italian", "JO": "jordanian", "KE": "kenyan", "KR": "south korean", "KZ": "kazakh", "LB": "lebanese", "LU": "luxembourgish", "MT": "maltese",
    "MX": "mexican", "NG": "nigerian", "NL": "dutch", "NO": "norwegian", "PA": "panamanian", "PL": "polish", "PT": "portuguese", "RS": "serbian",
    "SE": "swedish", "SK": "slovak", "TR": "turkish", "TT": "trinidadian", "UA": "ukrainian", "US": "american", "VN": "vietnamese",
    "NE": "nigerien", "SI": "slovenian", "KP": "north korean", "RU": "russian", "CN": "chinese", "JP": "japanese", "BR": "brazilian",
}

# Names in use that locale data do not give.
OTHER = {
    "AE": ["emirates", "uae"], "BA": ["bih", "bosnia", "bosna i hercegovina"], "CH": ["swiss confederation", "confoederatio helvetica"], "CZ": ["czech republic"],
    "CI": ["ivory coast", "elfenbeinkuste"], "CY": ["kypros"], "DE": ["brd", "frg", "bundesrepublik deutschland"], "EG": ["misr"], "ES": ["espana"], "FR": ["french republic", "republique francaise"], "GB": ["uk", "great britain", "britain", "england", "scotland", "wales"],
    "GR": ["hellenic republic", "hellas", "el"], "IE": ["eire"], "IN": ["bharat", "hindustan"], "IR": ["persia", "iran islamic republic of"], "KR": ["korea republic of", "republic of korea", "rok"],
    "KP": ["dprk"], "KZ": ["qazaqstan", "kazakstan"], "LU": ["letzebuerg", "grand duchy of luxembourg"], "MX": ["united mexican states"], "NL": ["holland"], "NO": ["norge"], "PL": ["polska", "rzeczpospolita polska"], "SE": ["svensk", "sverige"],
    "TR": ["turkey", "turkiye"], "TT": ["trinidad", "tobago"], "US": ["america", "usa", "united states of america", "etats unis d amerique"], "VN": ["vietnam", "viet nam"], "AT": ["oesterreich"],
}

# Words of official forms, which tell no country from another.
FORM_WORDS = (
    "of the and republic kingdom state federal islamic arab hashemite commonwealth confederation socialist democratic people peoples rep grand duchy "
    "citizen national native by birth born in from de la le du des republique republica republik konigreich und et y i republika respublika "
    "ta республіка республика и"
).split()


def plain(text: str) -> str:
    """The same text as ``canonical.plain_words`` gives on the JVM side."""
    x = unicodedata.normalize("NFD", text.lower())
    x = "".join(c for c in x if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("ł", "l").replace("đ", "d")
    x = re.sub(r"(?<![^\W_])([^\W\d_])\.(?=[^\W\d_](?:\.|$|\s))", r"\1", x)
    return " ".join(re.sub(r"[\W_]+", " ", x).split())


@lru_cache(maxsize=4)
def _from_jvm(jvm_id: int, languages: tuple[str, ...]) -> tuple[tuple[str, str], ...]:
    spark = SparkSession.getActiveSession()
    locale = spark._jvm.java.util.Locale
    tongues = [locale.forLanguageTag(x) for x in languages]
    out = set()
    for code in locale.getISOCountries():
        place = locale("", code)
        out.add((code, code.lower()))
        out.add((code, plain(place.getISO3Country())))
        for tongue in tongues:
            name = place.getDisplayCountry(tongue)
            if name and name != code:
                out.add((code, plain(name)))
    return tuple(sorted(out))


def country_names(spark: SparkSession, languages: tuple[str, ...] = LANGUAGES) -> list[tuple[str, str]]:
    """(iso2, plain name) of all countries: a few thousand rows, whatever the data."""
    rows = set(_from_jvm(id(spark._jvm), languages))
    rows |= {(code, plain(x)) for code, x in DEMONYMS.items()}
    rows |= {(code, plain(x)) for code, names in OTHER.items() for x in names}
    return sorted(r for r in rows if r[1])
