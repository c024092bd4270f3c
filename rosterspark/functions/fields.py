"""Functions of record fields: names, dates, documents, ids, hashes, export escaping, redaction."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN_NAME = "Unknown Name"


def primary_name(names: Column) -> Column:
    """Whole name of the first entry; a placeholder if there is none."""
    return F.coalesce(F.nullif(F.get(names, F.lit(0))["whole_name"], F.lit("")), F.lit(UNKNOWN_NAME))


def alias_names(names: Column) -> Column:
    return F.transform(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))), lambda n: n["whole_name"])


def all_names(names: Column) -> Column:
    return F.transform(names, lambda n: n["whole_name"])


def format_births(births: Column) -> Column:
    """Each birth date as text: as written, else the range, else year-month-day without padding; blanks left out."""

    def one(b: Column) -> Column:
        span = F.concat_ws("-", F.coalesce(b["year_range_from"].cast("string"), F.lit("?")), F.coalesce(b["year_range_to"].cast("string"), F.lit("?")))
        day = F.concat_ws("-", b["birth_year"].cast("string"), b["birth_month"].cast("string"), b["birth_day"].cast("string"))
        has_span = (F.coalesce(b["year_range_from"], F.lit(0)) != 0) | (F.coalesce(b["year_range_to"], F.lit(0)) != 0)
        return F.when(F.coalesce(b["raw"], F.lit("")) != "", b["raw"]).when(has_span, span).when(F.coalesce(b["birth_year"], F.lit(0)) != 0, day).otherwise("")

    return F.filter(F.transform(F.coalesce(births, F.array()), one), lambda x: x != "")


def format_documents(documents: Column) -> Column:
    """Each document as ``label number (country) [caveats]``."""

    def one(d: Column) -> Column:
        caveats = F.concat_ws(", ", F.when(d["known_false"], "known false"), F.when(d["known_expired"], "expired"), F.when(d["reported_lost"], "reported lost"), F.when(d["revoked_by_issuer"], "revoked"))
        label = F.coalesce(F.nullif(d["type_description"], F.lit("")), F.nullif(d["type_code"], F.lit("")))
        country = F.nullif(d["country_iso2"], F.lit(""))
        return F.concat(F.concat_ws(" ", label, d["number"]), F.when(country.isNotNull(), F.concat(F.lit(" ("), country, F.lit(")"))).otherwise(""), F.when(caveats != "", F.concat(F.lit(" ["), caveats, F.lit("]"))).otherwise(""))

    return F.filter(F.transform(documents, one), lambda x: x != "")


def exact_key(c: Column) -> Column:
    """Lower case without blanks and hyphens, for exact comparison of numbers."""
    return F.regexp_replace(F.lower(c), r"[\s-]", "")


def matches_birth(births: Column, query: Column) -> Column:
    """Whether any formatted birth date contains the query text."""
    return F.exists(format_births(births), lambda b: F.contains(b, query))


def valid_entity_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]+$") & ~c.rlike(r"^__.*__$"), F.lit(False))


def content_hash(columns: dict[str, Column], arrays: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the fields in name order; null fields vanish and arrays count as unordered.

    Status, dates of listing and bookkeeping columns are the caller's to leave out.
    """
    parts = [(F.array_sort(F.transform(c, lambda x: F.to_json(F.struct(x.alias("v"))))) if name in arrays else c).alias(name) for name, c in sorted(columns.items())]
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def guarded(c: Column) -> Column:
    """A value for a spreadsheet: formulas made text by a leading apostrophe, '' for null."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def csv_escape(c: Column) -> Column:
    """A field for CSV: ``guarded``, and quoted where needed."""
    safe = guarded(c)
    return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def redact_emails(c: Column) -> Column:
    """E-mail addresses keep their first letter and domain."""
    return F.regexp_replace(c, r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***$2")


# Parts of keys whose values are never logged.
SECRET_KEYS = ["password", "token", "secret", "apikey", "api_key", "authorization", "cookie", "sessionid", "session_id"]


def redact_map(m: Column) -> Column:
    """A map for the log: secret keys' values hidden, e-mails masked in the others."""
    hidden = "(?i)" + "|".join(SECRET_KEYS)
    return F.transform_values(m, lambda k, v: F.when(k.rlike(hidden), F.lit("[REDACTED]")).otherwise(redact_emails(v)))


def token_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def token_preview(c: Column) -> Column:
    """Fixed prefix, dots and the last four letters."""
    return F.concat(F.substring_index(c, "_", 1), F.lit("_..."), F.right(c, F.lit(4)))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id from content, the same in every run."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))


def sign(body: str, secret: str, at: int) -> str:
    """``t=...,v1=...``: HMAC-SHA256 of time and body."""
    return f"t={at},v1=" + hmac.new(secret.encode(), f"{at}.{body}".encode(), hashlib.sha256).hexdigest()


def verify(body: str, header: str, secret: str, now: int, tolerance: int = 300) -> bool:
    """Whether the signature is the body's and no more than ``tolerance`` seconds from now."""
    parts = dict(p.split("=", 1) for p in header.split(",") if "=" in p)
    try:
        at = int(parts["t"])
    except (KeyError, ValueError):
        return False
    return abs(now - at) <= tolerance and hmac.compare_digest(sign(body, secret, at), f"t={at},v1=" + parts.get("v1", ""))


def signature_udf(secret: str):
    @F.pandas_udf(T.StringType())
    def run(body: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([sign(b or "", secret, int(t)) for b, t in zip(body, at)])

    return run
