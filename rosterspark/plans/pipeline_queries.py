"""Queries p1, p5 and p6: the general data problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.operators import packed, rejects, snapshots
from rosterspark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.unpack_fields(table(spark, sf_dir, "test_pep"), ["row_no"], packed.PEP_FIELDS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "record_snapshot")
    applied = table(spark, sf_dir, "import_log").where("status = 'applied'").select("source", "snapshot_no")
    text = snapshots.canonical_text
    status = F.lower(text(F.col("status")))
    compared = [
        *[text(F.col(c)) for c in ("type", "primary_name", "birth_date")],
        snapshots.canonical_set(F.col("citizenships")),
        *[text(F.col(c)) for c in ("united_nation_id", "programme", "sanction_reason")],
        F.when(status == "", "active").otherwise(status),
        text(F.col("delisted_at")),
    ]
    return snapshots.snapshot_changes(rows, applied, "source", "snapshot_no", "record_id", "line_no", compared)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(rejects.parse_uploads(table(spark, sf_dir, "pep_raw")))


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.loadable(rejects.parse_uploads(table(spark, sf_dir, "pep_raw")))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p6_found": p6_found, "p6_loaded": p6_loaded}

_TRIMMED = ", ".join(f"trim(coalesce({c}::varchar, ''))" for c in ("type", "primary_name", "birth_date", "united_nation_id", "programme", "sanction_reason", "delisted_at"))
_SET = "array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(citizenships, []), lambda x: trim(coalesce(x, ''))), lambda x: x <> ''))), '~')"
_STATE = f"""select source, snapshot_no, record_id, concat_ws('|', {_TRIMMED}, {_SET}, coalesce(nullif(lower(trim(coalesce(status, ''))), ''), 'active')) as state from record_snapshot
 qualify row_number() over (partition by source, snapshot_no, record_id order by line_no desc) = 1"""
_STEPS = "select source, snapshot_no, lag(snapshot_no) over (partition by source order by snapshot_no) as prev from (select distinct source, snapshot_no from import_log where status = 'applied')"

ORACLES = {
    "p5_found": f"""with s as ({_STATE}), a as (select * from ({_STEPS}) where prev is not null),
 n as (select a.source, a.snapshot_no, record_id, state from a join s on s.source = a.source and s.snapshot_no = a.snapshot_no), o as (select a.source, a.snapshot_no, record_id, state from a join s on s.source = a.source and s.snapshot_no = a.prev)
 select source, snapshot_no, record_id, case when o.state is null then 'added' when n.state is null then 'removed' else 'changed' end as change_kind from n full outer join o using (source, snapshot_no, record_id) where n.state is distinct from o.state""",
}
