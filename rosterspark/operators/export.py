"""Exports and figures: CSV lines, filters of an export, counts, percentiles, run summaries, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.functions.fields import alias_names, csv_escape, format_births, format_documents, guarded, primary_name

# Columns of the CSV export, in order.
CSV_HEADERS = [
    "id", "source", "type", "primaryName", "aliases", "status", "score", "matchedAlias", "birthDates", "placesOfBirth",
    "citizenships", "identifications", "addresses", "sanctionReason", "legalBasis", "unitedNationId", "euReferenceNumber", "listedAt", "delistedAt", "updatedAt",
]


def export_filter(records: DataFrame, status: str = "active", source: str | None = None, type: str | None = None, import_id: str | None = None, whole_only: bool = True) -> DataFrame:
    """Records of an export; ``status`` active, delisted or all; ``import_id`` first or last saw them; rows without source or type are left out unless not ``whole_only``."""
    out = records if status == "all" else records.where(F.coalesce("status", F.lit("active")) == status)
    if source:
        out = out.where(F.col("source") == source.upper())
    if type:
        out = out.where(F.col("type") == type.lower())
    if import_id:
        out = out.where((F.col("first_seen_import") == import_id) | (F.col("last_seen_import") == import_id))
    return out.where("source is not null and type is not null") if whole_only else out


def export_values(records: DataFrame) -> list[Column]:
    """The columns of the export, in the order of ``CSV_HEADERS``. Lists are joined by ``; ``; columns that ``records`` lacks are empty."""
    has = set(records.columns)
    empty = F.lit("")
    many = lambda c: F.concat_ws("; ", c)
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    one = lambda c: F.col(c) if c in has else empty

    def address(a: Column) -> Column:
        parts = F.concat_ws(", ", F.nullif(a["street"], empty), F.nullif(a["city"], empty), F.nullif(a["country"], empty))
        return F.coalesce(F.nullif(a["full_address"], empty), F.nullif(parts, empty))

    return [
        F.col("record_id"), one("source"), one("type"), primary_name(F.col("names")), many(F.transform(alias_names(F.col("names")), lambda x: F.coalesce(x, empty))), F.coalesce("status", F.lit("active")),
        one("score"), one("matched_name"), many(format_births(F.col("birth_dates"))), many(F.col("places_of_birth")) if "places_of_birth" in has else empty, many(F.col("citizenships")) if "citizenships" in has else empty,
        many(format_documents(F.col("identifications"))) if "identifications" in has else empty, many(F.array_compact(F.transform("addresses", address))), one("sanction_reason"), one("legal_basis"),
        one("united_nation_id"), one("eu_ref_number"), F.coalesce(time("listed_at"), time("created_at")), time("delisted_at"), time("updated_at"),
    ]


def csv_lines(records: DataFrame) -> DataFrame:
    """(record_id, line) of the export."""
    return records.select("record_id", F.concat_ws(",", *[csv_escape(v) for v in export_values(records)]).alias("line"))


def write_csv(records: DataFrame, path: str) -> None:
    """The export as CSV files, each with its header, lines ended by CR LF; formulas are made text."""
    safe = [guarded(v).alias(h) for h, v in zip(CSV_HEADERS, export_values(records))]
    records.select(*safe).write.mode("overwrite").csv(path, header=True, lineSep="\r\n", escape='"', emptyValue="")


# Columns of a shown result list, in order.
RESULT_HEADERS = ["id", "source", "type", "primaryName", "aliases", "score", "matchedAlias", "status", "birthDates"]


def result_lines(hits: DataFrame, records: DataFrame) -> DataFrame:
    """(q_id, rank, line): the nine columns of a shown result list as CSV lines, quoted only where needed, in order of ``rank``.

    ``hits``: q_id, record_id, rank, score, matched_name; ``records``: record_id, source, type, status, names, birth_dates.
    """
    empty = F.lit("")
    full = hits.select("q_id", "record_id", "rank", "score", "matched_name").join(records.select("record_id", "source", "type", "status", "names", "birth_dates"), "record_id")
    values = [
        F.col("record_id"), F.col("source"), F.col("type"), primary_name(F.col("names")), F.concat_ws("; ", F.transform(alias_names(F.col("names")), lambda x: F.coalesce(x, empty))),
        F.col("score").cast("string"), F.col("matched_name"), F.coalesce(F.nullif("status", empty), F.lit("active")), F.concat_ws("; ", format_births(F.col("birth_dates"))),
    ]
    quote = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return full.select("q_id", "rank", F.concat_ws(",", *[quote(F.coalesce(v, empty)) for v in values]).alias("line"))


def search_summary(queries: DataFrame, hits: DataFrame, sources: list[str], limit: int) -> DataFrame:
    """(q_id, total_matches, shown, truncated, sources_searched) of every query, also those without a hit. ``hits``: all of them, before the limit."""
    counts = hits.groupBy("q_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return queries.select("q_id").distinct().join(counts, "q_id", "left").select("q_id", n.alias("total_matches"), F.least(n, F.lit(limit)).alias("shown"), (n > limit).alias("truncated"), F.lit(",".join(sorted(sources))).alias("sources_searched"))


def counts_by_source(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.coalesce("status", F.lit("active")) != "delisted").alias("active"), F.count_if(F.col("status") == "delisted").alias("delisted"))


def records_per_source(imports: DataFrame) -> DataFrame:
    """(source, records): the largest applied import of each source, and their sum as ``all``. ``imports``: source, status, uploaded (parsed optional)."""
    n = F.coalesce("uploaded", *(["parsed"] if "parsed" in imports.columns else []), F.lit(0))
    each = imports.where("status = 'applied'").groupBy("source").agg(F.max(n).alias("n"))
    return each.rollup("source").agg(F.sum("n").alias("records")).withColumn("source", F.coalesce("source", F.lit("all")))


def percentiles(df: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """Per key the value at place floor(n * p) of the sorted values (from 0)."""
    w = Window.partitionBy(key)
    x = df.select(key, F.col(value).alias("v"), (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return x.groupBy(key).agg(*[F.round(F.max(F.when(F.col("i") == F.floor(F.col("n") * p), F.col("v"))), 6).alias(name) for name, p in at.items()])


def run_summary(hits: DataFrame) -> DataFrame:
    """Per subject: matches, cleared ones, new alerts and the best score."""
    return hits.groupBy("subject_id").agg(F.count("*").alias("matches"), F.count_if("auto_cleared").alias("auto_cleared"), F.count_if(~F.col("auto_cleared")).alias("new_alerts"), F.max("score").alias("best"))


def recall(asked: DataFrame, found: DataFrame) -> DataFrame:
    """One row: queries, found ones, recall. ``asked``: q_id, expected; ``found``: q_id, record_id."""
    j = asked.join(found.select("q_id", F.col("record_id").alias("expected"), F.lit(1).alias("hit")), ["q_id", "expected"], "left")
    return j.agg(F.count("*").alias("queries"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
