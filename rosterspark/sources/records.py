"""The unified record schema that all list sources are read into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

NAME = "struct<whole_name:string,first_name:string,middle_name:string,last_name:string,strong:boolean,language:string,title:string,func:string>"
BIRTH = "struct<raw:string,birth_year:int,birth_month:int,birth_day:int,year_range_from:int,year_range_to:int,circa:boolean,city:string,place:string,country_iso2:string>"
DOCUMENT = (
    "struct<number:string,type_code:string,type_description:string,country_iso2:string,issued_by:string,"
    "known_false:boolean,known_expired:boolean,reported_lost:boolean,revoked_by_issuer:boolean,diplomatic:boolean>"
)
ADDRESS = "struct<street:string,city:string,country:string,full_address:string,po_box:string,region:string,place:string,country_iso2:string>"
REGULATION = "struct<number_title:string,programme:string,publication_date:string,entry_into_force_date:string,url:string>"
CONTACT = "struct<phone_numbers:array<string>,fax_numbers:array<string>,emails:array<string>,websites:array<string>>"

#: Columns of a record and their types, in order.
RECORD = {
    "id": "string", "source": "string", "type": "string", "names": f"array<{NAME}>", "birth_dates": f"array<{BIRTH}>", "places_of_birth": "array<string>",
    "citizenships": "array<string>", "identifications": f"array<{DOCUMENT}>", "addresses": f"array<{ADDRESS}>", "sanction_reason": "string", "legal_basis": "string",
    "united_nation_id": "string", "eu_reference_number": "string", "source_ref": "string", "regulation": REGULATION, "contact_info": CONTACT, "status": "string",
    "listed_at": "string", "delisted_at": "string",
}


def text(c: Column) -> Column:
    """Trimmed; '' for null."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def filled(c: Column) -> Column:
    """Trimmed; null for blank."""
    return F.nullif(text(c), F.lit(""))


def items(c: Column, kind: str | DataType) -> Column:
    """An array column, empty for null."""
    return F.coalesce(c, F.array().cast(kind))


def shaped(kind: str, **fields: Column) -> Column:
    """A struct of type ``kind`` from some of its fields; the others are null."""
    inner = kind[len("struct<") : -1]
    parts, depth, at = [], 0, 0
    for i, ch in enumerate(inner + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(inner[at:i].split(":", 1))
            at = i + 1
    return F.struct(*[(fields[n].cast(t) if n in fields else F.lit(None).cast(t)).alias(n) for n, t in parts])


def none_if_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def first_by(c: Column, field: str, kind: str) -> Column:
    """Structs of an array without those whose ``field`` came before."""
    return F.aggregate(c, F.array().cast(f"array<{kind}>"), lambda acc, x: F.when(F.exists(acc, lambda y: y[field] == x[field]), acc).otherwise(F.concat(acc, F.array(x))))


def first_to_front(c: Column, chosen: Column) -> Column:
    """The array with its element at ``chosen`` (from 0) put first."""
    rest = F.filter(c, lambda x, i: i != chosen)
    return F.concat(F.array(F.get(c, chosen)), rest)


def joined(*parts: Column, sep: str = ", ") -> Column:
    """The non-blank parts in one text; null if there are none."""
    return F.nullif(F.concat_ws(sep, *[filled(p) for p in parts]), F.lit(""))


def safe_key(c: Column) -> Column:
    """Whether a native id can be part of a record id."""
    return c.rlike(r"^[A-Za-z0-9._-]{1,200}$")


def as_records(df: DataFrame) -> DataFrame:
    """``df`` with all columns of ``RECORD`` in order, missing ones null."""
    return df.select(*[(F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in RECORD.items()])


def unknown_name() -> Column:
    """The entry of a record without any name."""
    return shaped(NAME, whole_name=F.lit("Unknown Name"), strong=F.lit(False))
