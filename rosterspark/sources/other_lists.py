"""Lists that are not XML: paged JSON of the Ukrainian register, CSV lists, and what a file is."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterspark.operators import rejects
from rosterspark.sources.records import ADDRESS, BIRTH, DOCUMENT, NAME, REGULATION, as_records, filled, first_by, items, joined, none_if_empty, shaped, text

_DECREE = "struct<number:string,date:string,url:string>"
UA_PERSON = f"data array<struct<id:string,lastName:string,firstName:string,middleName:string,dateOfBirth:string,passports:array<struct<series:string,number:string,type:string>>,ipn:string,aliases:array<struct<lastName:string,firstName:string,middleName:string>>,status:string,decree:{_DECREE}>>"
UA_ENTITY = f"data array<struct<id:string,fullName:string,shortName:string,edrpou:string,aliases:array<struct<fullName:string,shortName:string>>,status:string,decree:{_DECREE}>>"


def _decree(c: Column) -> Column:
    return F.when(c.isNotNull(), shaped(REGULATION, number_title=F.concat(F.lit("Decree "), text(c["number"])), publication_date=text(c["date"]), url=filled(c["url"])))


def _status(c: Column) -> Column:
    return F.when(text(c) == "revoked", "delisted").otherwise("active")


def read_ua(spark: SparkSession, people: str, entities: str) -> DataFrame:
    """Page dumps of persons and of legal entities; names are last, first, middle; numbers stay text. A row that is no object is skipped."""
    person = spark.read.schema(UA_PERSON).option("multiLine", "true").option("primitivesAsString", "true").json(people).select(F.explode("data").alias("d")).where("d is not null").select("d.*")
    full = lambda r: joined(r["lastName"], r["firstName"], r["middleName"], sep=" ")
    me = {c: F.col(c) for c in ("lastName", "firstName", "middleName")}
    primary = F.coalesce(full(me), F.lit("Unknown"))
    aliases = F.transform(items(F.col("aliases"), "array<struct<lastName:string,firstName:string,middleName:string>>"), lambda a: shaped(NAME, whole_name=full(a), strong=F.lit(False)))
    iso, dob = r"^(\d{4})-(\d{2})-(\d{2})$", text(F.col("dateOfBirth"))
    part = lambda i: F.nullif(F.regexp_extract(dob, iso, i), F.lit("")).cast("int")
    birth = shaped(BIRTH, raw=dob, birth_year=F.coalesce(part(1), F.nullif(F.regexp_extract(dob, r"^(\d{4})$", 1), F.lit("")).cast("int")), birth_month=part(2), birth_day=part(3))
    passports = F.transform(F.filter(items(F.col("passports"), "array<struct<series:string,number:string,type:string>>"), lambda p: text(p["number"]) != ""), lambda p: shaped(DOCUMENT, number=F.concat(text(p["series"]), text(p["number"])), type_code=F.lit("passport"), type_description=F.coalesce(filled(p["type"]), F.lit("passport"))))
    tax = F.when(filled(F.col("ipn")).isNotNull(), F.array(shaped(DOCUMENT, number=filled(F.col("ipn")), type_code=F.lit("tax_id"), type_description=F.lit("Individual Tax Number (IPN)")))).otherwise(F.array().cast(f"array<{DOCUMENT}>"))
    a = person.select(
        F.concat(F.lit("UA-"), text(F.col("id"))).alias("id"), F.lit("UA").alias("source"), F.lit("individual").alias("type"),
        F.concat(F.array(shaped(NAME, whole_name=primary, strong=F.lit(True))), F.filter(aliases, lambda n: n["whole_name"].isNotNull() & (n["whole_name"] != primary))).alias("names"),
        F.when(dob != "", F.array(birth)).alias("birth_dates"), none_if_empty(F.concat(passports, tax)).alias("identifications"), _status(F.col("status")).alias("status"), _decree(F.col("decree")).alias("regulation"),
    )
    body = spark.read.schema(UA_ENTITY).option("multiLine", "true").option("primitivesAsString", "true").json(entities).select(F.explode("data").alias("d")).where("d is not null").select("d.*")
    called = lambda r: F.coalesce(filled(r["fullName"]), filled(r["shortName"]))
    first = F.coalesce(called({c: F.col(c) for c in ("fullName", "shortName")}), F.lit("Unknown"))
    others = F.transform(items(F.col("aliases"), "array<struct<fullName:string,shortName:string>>"), lambda n: shaped(NAME, whole_name=called(n), strong=F.lit(False)))
    b = body.select(
        F.concat(F.lit("UA-"), text(F.col("id"))).alias("id"), F.lit("UA").alias("source"), F.lit("entity").alias("type"),
        F.concat(F.array(shaped(NAME, whole_name=first, strong=F.lit(True))), F.filter(others, lambda n: n["whole_name"].isNotNull() & (n["whole_name"] != first))).alias("names"),
        F.when(filled(F.col("edrpou")).isNotNull(), F.array(shaped(DOCUMENT, number=filled(F.col("edrpou")), type_code=F.lit("edrpou"), type_description=F.lit("ЄДРПОУ (Ukrainian Company Registry Number)")))).alias("identifications"),
        _status(F.col("status")).alias("status"), _decree(F.col("decree")).alias("regulation"),
    )
    return as_records(a).unionByName(as_records(b))


# --- CSV lists -------------------------------------------------------------------------------------

LIST_SOURCES = ("EU", "UN", "US", "UK", "CH", "UA", "PEP", "CUSTOM")


def read_csv_list(spark: SparkSession, path: str, separator: str = ";", source: str = "PEP") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a CSV list with a header of known or unknown names.

    Values split on ``|``. A row is rejected for the first reason that applies: malformedColumns (fewer values than
    the header), missingName, sourceMismatch (its source is another), invalidId. Further columns are tolerated. Without
    an id column the row number makes the id. Rejects: row_no, reason.
    """
    source = source if source in LIST_SOURCES else "PEP"
    lines = spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "^﻿|\r$", "").alias("line")).where(F.trim("line") != "")
    head = lines.orderBy("n").first()
    schema_rows = "row_no long, " + ", ".join(f"`{f}` string" for f in (*rejects.HEADERS, "street", "city", "country", "legal_basis", "reason_")) + ", raw map<string,string>, failure string"
    if head is None:
        empty = spark.createDataFrame([], schema_rows)
        return as_records(empty.select(F.lit("").alias("id")).where("false")), empty.select("row_no", F.col("failure").alias("reason"))
    names = [h.strip("﻿ \"").lower() for h in (rejects.strict_values(head.line, separator) or head.line.split(separator))]
    values = F.from_csv("line", ", ".join(f"c{i} string" for i in range(len(names) + 1)), {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    # positions within partitions are not row numbers: count the lines before each partition once
    body = lines.where(F.col("n") > head.n).select("n", "line", values.alias("v"), F.size(F.split(F.regexp_replace("line", r'"(?:[^"]|"")*"', ""), re.escape(separator), -1)).alias("width"))
    starts = body.groupBy(F.shiftright("n", 33).alias("p")).agg(F.count("*").alias("c"))
    before = starts.withColumn("before", F.sum("c").over(Window.orderBy("p")) - F.col("c")).select("p", "before")
    numbered = body.withColumn("p", F.shiftright("n", 33)).join(F.broadcast(before), "p").withColumn("row_no", F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("n")))
    get = lambda *aliases: F.coalesce(*[F.nullif(F.trim(F.col(f"v.c{names.index(a)}")), F.lit("")) for a in aliases if a in names], F.lit(None).cast("string"))
    has_id = any(a in names for a in rejects.HEADERS["id"])
    row = {f: get(*a) for f, a in rejects.HEADERS.items()}
    key = row["id"] if has_id else F.concat(F.lit("row-"), F.col("row_no").cast("string"))
    reason = (
        F.when(F.col("width") < len(names), "malformedColumns")
        .when(row["name"].isNull(), "missingName")
        .when(row["source"].isNotNull() & (F.upper(row["source"]) != source), "sourceMismatch")
        .when(~F.coalesce(key.rlike(r"^[A-Za-z0-9_-]+$") & ~key.rlike(r"^__.*__$"), F.lit(False)), "invalidId")
    )
    many = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    kind = F.lower(F.coalesce(row["type"], F.lit("individual")))
    street, city, country = get("street", "address"), get("city"), get("country")
    full = F.coalesce(row["full_address"], joined(street, city, country))
    judged = numbered.withColumn("reason_", reason)
    good = judged.where("reason_ is null").select(
        F.concat(F.lit(source + "-"), key).alias("id"), F.lit(source).alias("source"),
        F.when(kind.rlike("entity|organisation|bolag"), "entity").when(kind.contains("vessel"), "vessel").when(kind.contains("aircraft"), "aircraft").otherwise("individual").alias("type"),
        first_by(F.concat(F.array(shaped(NAME, whole_name=row["name"], strong=F.lit(True))), F.transform(many(row["aliases"]), lambda a: shaped(NAME, whole_name=a, strong=F.lit(False)))), "whole_name", NAME).alias("names"),
        none_if_empty(F.transform(many(row["dates_of_birth"]), lambda d: shaped(BIRTH, raw=d))).alias("birth_dates"), none_if_empty(many(row["citizenships"])).alias("citizenships"),
        none_if_empty(F.transform(many(row["passports"]), lambda n: shaped(DOCUMENT, number=n))).alias("identifications"),
        F.when(full.isNotNull(), F.array(shaped(ADDRESS, street=street, city=city, country=country, full_address=full))).alias("addresses"), row["reason"].alias("sanction_reason"), get("legalbasis", "law").alias("legal_basis"),
    )
    return as_records(good), judged.where("reason_ is not null").select("row_no", F.col("reason_").alias("reason"))


# --- Files -----------------------------------------------------------------------------------------


def formats(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, format, generated_at) of each file: its kind and date from its own first 4096 characters.

    Files are read whole for the digest, one per task at a time.
    """
    files = spark.read.format("binaryFile").load(path)
    head = F.regexp_replace(F.decode(F.substring("content", 1, 16384), "UTF-8"), r"^﻿?\s*", "")
    h = F.substring(head, 1, 4096)
    xml = h.startswith("<?xml")
    lines = F.split(h, r"\r?\n")
    first, column = F.lower(F.get(lines, F.lit(0))), F.nullif(F.trim(F.split(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), ";")[0]), F.lit(""))
    # What each publication begins with.
    kinds = [
        ("eu-xml-1.1", xml & (h.contains("<export ") | h.contains('xmlns="http://eu.europa.ec/fpi/fsd/export"')), r'<export[^>]*\sgenerationDate="([^"]*)"'),
        ("un-xml", xml & h.contains("<CONSOLIDATED_LIST"), r'<CONSOLIDATED_LIST[^>]*\sdateGenerated="([^"]*)"'),
        ("us-xml", xml & h.contains("<sdnList"), r"<Publish_Date>([^<]*)</Publish_Date>"),
        ("uk-xml", xml & h.contains("<Designations"), r"<DateGenerated>([^<]*)</DateGenerated>"),
        ("ch-xml", xml & h.rlike(r"<target\s[^>]*ssid="), r'\sdate="([^"]*)"'),
    ]
    name = F.when(kinds[0][1], kinds[0][0])
    date = F.when(kinds[0][1], F.regexp_extract(h, kinds[0][2], 1))
    for k, test, pattern in kinds[1:]:
        name, date = name.when(test, k), date.when(test, F.regexp_extract(h, pattern, 1))
    name = name.when(~xml & first.startswith("date_file;"), "eu-csv-1.0").when(~xml & first.startswith("filegenerationdate;"), "eu-csv-1.1").otherwise("csv")
    date = date.when(~xml & (first.startswith("date_file;") | first.startswith("filegenerationdate;")), column)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), name.alias("format"), F.nullif(date, F.lit("")).alias("generated_at"))


def complete(files: DataFrame, expected: DataFrame, most_bytes: int = 200 * 1024 * 1024) -> DataFrame:
    """``files`` with ``complete``: of the announced length (``expected``: path, content_length) and not over the limit."""
    return files.join(expected, "path", "left").withColumn("complete", (F.col("size") <= most_bytes) & F.coalesce(F.col("size") == F.col("content_length"), F.lit(True)))


def confined_path(path: str, base: str) -> str:
    """``path`` resolved, if it lies under ``base``; else ValueError."""
    if "\0" in path:
        raise ValueError("null byte in path")
    root = os.path.realpath(base)
    full = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([root, full]) != root or full == root:
        raise ValueError("path leaves its folder")
    return full


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, name) of a batch file: trimmed lines without blank ones and ``#`` comments."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("q_id"), F.trim("value").alias("name"))
    return lines.where("name <> '' and not startswith(name, '#')")
