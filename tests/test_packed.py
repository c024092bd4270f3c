"""Packed fields: each case as written, against the values a person reads in it."""

import pytest

from rosterspark.operators.packed import PEP_FIELDS, unpack_fields

CASES = [
    ("aliases", 'A One|B Two; C Three', ["A One", "B Two", "C Three"]),
    ("aliases", '"Two, A.",A Two', ["Two, A.", "A Two"]),
    ("aliases", '"Rik ""Ri"" Ma";Ma Rik', ['Rik "Ri" Ma', "Ma Rik"]),
    ("aliases", 'Rik "Ri" Ma / Ma Rik', ['Rik "Ri" Ma', "Ma Rik"]),
    ("aliases", "'Mo, A ibn Z', 'Hon. A Mo'", ["Mo, A ibn Z", "Hon. A Mo"]),
    ("aliases", '1) A Mo 2) "Mo, A" 3) al Mo', ["A Mo", "Mo, A", "al Mo"]),
    ("aliases", "A Mo; a.k.a. B Mo; a.k.a. C Mo", ["A Mo", "B Mo", "C Mo"]),
    ("aliases", "Hombrecht, Anna", ["Hombrecht, Anna"]),
    ("aliases", "Anna Hombrecht, Ana Hombrect", ["Anna Hombrecht", "Ana Hombrect"]),
    ("aliases", "M/V Brak;;MV Brak", ["M/V Brak", "MV Brak"]),
    ("aliases", "Côte d'Or\tD'Arc, J|", ["Côte d'Or", "D'Arc, J"]),
    ("aliases", 'open "quote; x', ["open \"quote", "x"]),
    ("aliases", " | ;; ", []),
    ("aliases", "", []),
    ("aliases", None, []),
    ("dates_of_birth", '"Apr 14, 1985" or c. 1987', ["Apr 14, 1985", "c. 1987"]),
    ("dates_of_birth", "Mar 8, 1961|26/01/1959", ["Mar 8, 1961", "26/01/1959"]),
    ("dates_of_birth", "5 May 1966, 1966", ["5 May 1966", "1966"]),
    ("dates_of_birth", "1994-1997;;11.06.1996", ["1994-1997", "11.06.1996"]),
    ("citizenships", "Bosnia and Herzegovina and Kenya", ["Bosnia and Herzegovina", "Kenya"]),
    ("citizenships", "Stateless person, State of Malta and Polen", ["Stateless person", "State of Malta", "Polen"]),
    ("citizenships", "Spain|Korea, Republic of", ["Spain", "Korea, Republic of"]),
    ("citizenships", '"Iran, Islamic Republic of"; Malta', ["Iran, Islamic Republic of", "Malta"]),
    ("citizenships", "Trinidad & Tobago", ["Trinidad & Tobago"]),
    ("citizenships", "Norway,Norway", ["Norway", "Norway"]),
    ("passports", "83/409875 / 0031680979", ["83/409875", "0031680979"]),
    ("passports", "FE14948638,0075811178,", ["FE14948638", "0075811178"]),
    ("passports", "x" * 20000 + ";y", ["x" * 20000, "y"]),
]


def test_cases(spark):
    rows = [{"row_no": i, **{f: (text if f == field else None) for f in PEP_FIELDS}, "pos": 7, "item": "clash"} for i, (field, text, _) in enumerate(CASES)]
    schema = "row_no long, " + ", ".join(f"{f} string" for f in PEP_FIELDS) + ", pos int, item string"
    df = spark.createDataFrame([[r[c] for c in ("row_no", *PEP_FIELDS, "pos", "item")] for r in rows], schema)
    got: dict[int, list] = {}
    for r in unpack_fields(df, ["row_no"], PEP_FIELDS).orderBy("row_no", "pos").collect():
        got.setdefault(r.row_no, []).append((r.pos, r.item))
        assert r.field_name == CASES[r.row_no][0]
    for i, (_, text, want) in enumerate(CASES):
        assert got.get(i, []) == list(enumerate(want)), text


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_no long, " + ", ".join(f"{f} string" for f in PEP_FIELDS))
    assert unpack_fields(df, ["row_no"], PEP_FIELDS).count() == 0


@pytest.mark.parametrize("field", list(PEP_FIELDS))
def test_no_shuffle(spark, field):
    df = spark.createDataFrame([], f"row_no long, {field} string")
    plan = unpack_fields(df, ["row_no"], {field: PEP_FIELDS[field]})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
