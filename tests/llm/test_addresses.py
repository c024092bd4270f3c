"""Addresses: the same building in many writings, and its neighbours."""

from rosterspark.llm.addresses import classes, links, same_building

REF = [("SE", "SWE", "Sweden"), ("DE", "DEU", "Germany"), ("NO", "NOR", "Norway"), ("GB", "GBR", "United Kingdom")]
KIND = "address_id long, street string, city string, country string, full_address string, po_box string, region string, place string, country_iso2 string, id string, tokens string"
SAME = [
    ("Trikhegrengatan 117", "Göteborg", "Sweden", "Trikhegrengatan 117, 667 50 Göteborg, Sweden", None, "SE"),
    ("Trikhegreng. 117, of. 29", "Goteborg", None, "Trikhegreng. 117, of. 29 - Goteborg - Sweden", None, None),
    (None, None, None, "SE-667 50 Göteborg; Trikhegren gata nr 117; Sverige", None, "00"),
    ("c/o Registered Agent, Trikhegerngatan #117", "Göteborg", "Swedne", None, "POB 119", None),
    ("Trikhegrengatan 117, 4. floor", "GÖTEBORG", "sweden", None, None, "se"),
]
OTHER = [
    ("Trikhegrengatan 119", "Göteborg", "Sweden", "Trikhegrengatan 119, 667 50 Göteborg, Sweden", None, "SE"),
    ("Trikhegrenstrasse 117", "Hamburg", "Germany", "Trikhegrenstrasse 117, 20095 Hamburg, Germany", None, "DE"),
    ("Trikhegrengatan", "Göteborg", "Sweden", "Trikhegrengatan, 667 50 Göteborg, Sweden", None, "SE"),
    (None, "Göteborg", "Sweden", "P.O. Box 117, Göteborg, Sweden", "P.O. Box 117", "SE"),
    (None, None, None, None, None, None), ("", "", "-", "unknown", None, None), ("117", None, None, None, None, None),
    ("Skonderaalweg 8", "Hamburg", "Germany", None, None, "DE"),
]
FILL = [(f"{w} {i}", c, l, None, None, None) for i, (w, c, l) in enumerate([(f"Fyll{chr(97 + i % 26)}orken{chr(97 + i // 26)}vägen", ["Oslo", "Bergen", "Göteborg", "Hamburg"][i % 4], ["Norway", "Norway", "Sweden", "Germany"][i % 4]) for i in range(120)], 200)]


def frame(spark, rows):
    return spark.createDataFrame([(i, s, c, land, f, po, None, None, iso, "clash", "clash") for i, (s, c, land, f, po, iso) in enumerate(rows)], KIND)


def ref(spark):
    return spark.createDataFrame(REF, "iso2 string, iso3 string, country_name string")


def test_same_building(spark):
    rows = SAME + [SAME[0]] + OTHER + FILL
    got = {tuple(r) for r in same_building(frame(spark, rows), "address_id", ref(spark)).collect()}
    n = len(SAME) + 1
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n)}


def test_hot_blocks_lose_nothing(spark):
    rows = [(f"Trikhegrengatan 117, Apt {i}", ["Göteborg", "Gothenburg", None][i % 3], ["Sweden", None][i % 2], f"note{chr(97 + i)}x Trikhegrengatan 117", None, None) for i in range(20)] + FILL
    members, profiles = classes(frame(spark, rows), "address_id", ref(spark))
    cold = {tuple(r)[:2] for r in links(profiles, hot=10**6).collect()}
    hot = {tuple(r)[:2] for r in links(profiles, hot=2).collect()}
    assert cold and hot == cold


def test_hot_blocks_without_a_common_token(spark):
    """Same number and street in many classes, the city mistyped: found in a large block too, as in a small one."""
    street = ("trikhegren", 5.7)
    rows = [("x", "117", [street, ("stockholm", 3.2), ("c:SE", 2.5)], "trikhegren"), ("y", "117", [street, ("stokholm", 8.0), ("z:11122", 6.0)], "trikhegren")]
    rows += [(f"f{i:03}", "117", [street, (f"fyll{chr(97 + i % 26)}orken{chr(97 + i // 26)}", 9.0), (f"z:{20000 + i}", 9.0)], "trikhegren") for i in range(100)]
    df = spark.createDataFrame(rows, "class_id string, house string, tokens array<struct<token:string,w:double>>, rarest string")
    cold = {tuple(r)[:2] for r in links(df, hot=10**6).collect()}
    assert ("x", "y") in cold and {tuple(r)[:2] for r in links(df).collect()} == cold


def test_empty(spark):
    df = frame(spark, SAME)
    assert same_building(df.where("false"), "address_id", ref(spark)).count() == 0
    assert same_building(frame(spark, [(None,) * 6] * 3), "address_id", ref(spark)).count() == 0
    long = [("Lang" + "weg " * 9000 + "12", None, None, None, None, None)] * 2
    assert same_building(frame(spark, long), "address_id", ref(spark)).count() <= 1
