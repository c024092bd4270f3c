"""Free values to canonical entries."""

from rosterspark.llm.canonical import map_countries

REF = [("SE", "SWE", "Sweden"), ("NG", "NGA", "Nigeria"), ("SK", "SVK", "Slovakia"), ("US", "USA", "United States"), ("GB", "GBR", "United Kingdom"), ("IR", "IRN", "Iran, Islamic Republic of"), ("DE", "DEU", "Germany"), ("MX", "MEX", "Mexico"), ("CI", "CIV", "Côte d'Ivoire"), ("AU", "AUS", "Australia"), ("AT", "AUT", "Austria"), ("KR", "KOR", "Korea, Republic of")]
CASES = {
    "sweden": "SE", " Swedne": "SE", "Sverige": "SE", "SUÈDE": "SE", "Швеція": "SE", "swe": "SE", '"SE"': "SE", "Kingdom of Sweden": "SE", "citizen of Sweden": "SE", "Sweden (by birth)": "SE", "Sweden [SE]": "SE", "Swedish": "SE",
    "Niger": "-", "Nigeira": "NG", "Slovenia": "-", "Slovvakia": "SK", "U.S.A.": "US", "United Sttes": "US", "United Mexican States": "MX", "Uinted Kingdom": "GB", "UK": "GB", "de": "DE", "Tyskland": "DE", "Persia": "IR", "Islamic Repulbic of Iran": "IR",
    "Austrai": "AT", "Austrlia": "AU", "Côte d'Ivorie": "CI", "South Korean": "KR", "North Korea": "-", "Republic of Talvenia": "-", "unknown": "-", "stateless": "-", "EU citizen": "-", "not stated": "-", "??": "-", "": "-", "x" * 5000: "-",
}


def test_cases(spark):
    ref = spark.createDataFrame(REF, "iso2 string, iso3 string, country_name string")
    df = spark.createDataFrame([(v, 1) for v in [*CASES, "sweden", None]], "typed string, code int")
    got = {r.typed: r.code for r in map_countries(df, "typed", ref).collect()}
    assert got.pop(None) == "-"
    assert {k: v for k, v in got.items() if v != CASES[k]} == {} and set(got) == set(CASES)


def test_empty(spark):
    ref = spark.createDataFrame(REF, "iso2 string, iso3 string, country_name string")
    df = spark.createDataFrame([("Sweden",)], "typed string")
    assert map_countries(df.where("false"), "typed", ref).count() == 0
    assert [r.code for r in map_countries(df, "typed", ref.where("false")).collect()] == ["-"]
