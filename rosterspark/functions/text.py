"""Text functions as native Column expressions: normalising, transliterating, tokens, Soundex.

Spark has no Unicode decomposition. What decomposition and removal of marks do to a precomposed letter
is a one-to-one mapping, so it is derived here from ``unicodedata`` for the alphabets with case and
accents, and applied by ``translate`` inside code generation.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks whose letters are decomposed: Latin, Greek, Cyrillic, Latin extended additional, Greek extended.
_BLOCKS = [(0x00C0, 0x0590), (0x1E00, 0x2000)]
#: Diacritics that are no combining marks: deleted, not turned into a blank.
_SPACING = "^`¨¯´·¸ʰʱʲʳʴʵʶʷʸʹʺʻʼˀˁ˂˃˄˅ˆˇˈˉˊˋˌˍˎˏːˑ˞ˠˡˢˣˤ˥ˬ˭ˮ"


@lru_cache(maxsize=1)
def accent_tables() -> tuple[str, str]:
    """(from, to) for ``translate``: accented letters to their base, then the marks to delete."""
    source, target = [], []
    for low, high in _BLOCKS:
        for code in range(low, high):
            c = chr(code)
            base = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
            if len(base) == 1 and base[0] != c:
                source.append(c)
                target.append(base[0])
    marks = [chr(c) for low, high in [(0x0300, 0x0370), (0x0483, 0x0488), (0x0591, 0x05C8), (0x064B, 0x0660), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100)] for c in range(low, high) if unicodedata.combining(chr(c))]
    return "".join(source + marks + list(_SPACING)), "".join(target)


# Transliteration of Cyrillic and Greek letters (after accents are removed).
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ы": "y", "ь": "", "э": "e", "ю": "yu",
    "я": "ya", "і": "i", "є": "ye", "ґ": "g",
}
GREEK = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k",
    "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t",
    "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}


def strip_accents(c: Column) -> Column:
    source, target = accent_tables()
    return F.translate(c, source, target)


def normalize_text(c: Column) -> Column:
    """Lower case, without diacritics, runs of all but letters, digits as one blank, trimmed; null gives ''."""
    bare = strip_accents(F.lower(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}\s]", " "), r"[\s ]+", " "))


def _mapped(c: Column, table: dict[str, str]) -> Column:
    one = {k: v for k, v in table.items() if len(v) == 1}
    none = "".join(k for k, v in table.items() if not v)
    out = F.translate(c, "".join(one) + none, "".join(one.values()))
    for k, v in table.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def latin(c: Column) -> Column:
    """Lower case without accents, Cyrillic and Greek letters in Latin ones; '' for null."""
    low = strip_accents(F.lower(F.coalesce(c, F.lit(""))))
    foreign = low.rlike("[" + "".join(CYRILLIC) + "".join(GREEK) + "]")
    return F.when(foreign, _mapped(_mapped(low, CYRILLIC), GREEK)).otherwise(low)


def transliterate(c: Column) -> Column:
    """``latin`` of a text that holds Cyrillic or Greek letters, else null."""
    low = strip_accents(F.lower(c))
    return F.when(low.rlike("[" + "".join(CYRILLIC) + "".join(GREEK) + "]"), _mapped(_mapped(low, CYRILLIC), GREEK))


def words(c: Column) -> Column:
    """Words of a normalised text; an empty text has none."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def soundex_code(c: Column) -> Column:
    """Soundex of the letters A-Z of ``c``; '' if there are none (also for null)."""
    clean = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", "")
    return F.when(clean == "", F.lit("")).otherwise(F.soundex(clean))


def search_tokens(names: Column) -> Column:
    """Distinct words of two letters or more of all names and their transliterations, as first seen."""
    both = F.transform(names, lambda n: F.concat(words(normalize_text(n)), words(normalize_text(transliterate(n)))))
    return F.array_distinct(F.filter(F.flatten(both), lambda w: F.length(w) >= 2))
