"""Queries that once covered a part of their operator's job."""

from rosterspark.operators import overlay
from rosterspark.plans import core_queries


def test_jaro_of_every_script(spark, tmp_path):
    rows = [(1, "r", 0, "Іван Петренко"), (2, "r", 1, "Iван Петренко"), (3, "s", 0, "Zoë Sund"), (4, "s", 1, "Zoe Sund"), (5, "s", 2, None)]
    spark.createDataFrame(rows, "alias_id long, record_id string, pos int, whole_name string").write.parquet(f"{tmp_path}/name_alias.parquet")
    for name in ("fn05_jaro_all", "fn06_jaro_winkler_all"):
        got = {r[0]: r[1] for r in core_queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert set(got) == {1, 2, 3, 4} and got[1] == 1 and 0.8 < got[2] <= 1


def test_existing_records_are_all_offered(spark, tmp_path, monkeypatch):
    """dml10 offers every stored record once more, and none is inserted twice."""
    kind = "id string, source string, type string, programme string, sanction_reason string"
    spark.createDataFrame([(f"r{i}", "EU", "individual", "P", None) for i in range(40)], kind).write.parquet(f"{tmp_path}/sanction_record.parquet")
    spark.createDataFrame([("n1",), (None,)], "id string").write.parquet(f"{tmp_path}/test_pep.parquet")
    offered = []
    insert = overlay.insert_missing
    monkeypatch.setattr(overlay, "insert_missing", lambda have, new, key: (offered.append(new.count()), insert(have, new, key))[1])
    got = {r.source: (r.n, r.fresh) for r in core_queries.QUERIES["dml10_custom_records"](spark, str(tmp_path)).collect()}
    assert offered == [41] and got == {"EU": (40, 0), "CUSTOM": (1, 1)}
