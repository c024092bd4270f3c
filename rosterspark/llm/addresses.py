"""Address rows of the same building, numbers first.

A row becomes sorted house numbers, postcodes, a country and a set of words, by SQL expressions; notes
that name no building (care of, floors, offices, post boxes) are taken out first. Rows with equal
outcome are one class. Classes meet in blocks of their sorted house numbers and half of one rare word
(a typing error spares the other half), and are linked by the rarity-weighted share of common words,
words left over being compared by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.functions.text import latin
from rosterspark.llm import canonical, places
from rosterspark.session import checkpointed

#: Least rarity-weighted overlap of two rows of the same building.
LEAST_OVERLAP = 0.57
#: Letters of each half of a rare word.
HALF = 4
#: A word is rare if its weight is at least this part of the row's largest.
RARE_PART = 0.6
#: Least similarity of two words left over that count as one.
WORD_SIMILARITY = 0.7
#: Classes in a block above which it is compared in tiles of parts of about this size, spread over tasks.
HOT_BLOCK = 64

# Words that name the kind of street, or note what is no part of a place.
STREET_KINDS = (
    "street str st road rd roard avenue ave av avda avenida boulevard boul blvd bulvar bul bvd bd prospekt prosp pr prospect pros vulytsia vulitsia vul ulitsa ulica ul "
    "plaza pza pl place platz square sq calle cl rue quarter qtr hay tariq shari sharia gatan gata gade gd gasse strasse weg vag vagen lane ln drive dr way court highway hwy"
).split()
NOTES = "bld bldg building block nr no num numero house tbc unknown none null and the of de la box near registered agent".split()

_SUFFIX = r"(?<=[\p{L}]{4})(?:gatan|gata|gade|gasse|strasse|vagen|weg)(?![\p{L}])|(?<=[\p{L}]{4})(?:gd|str|g|v|w)\."
_POST_BOX = r"(?:p\.?\s?o\.?\s?b(?:ox)?\.?|post\s?box|postbox|postfach|apdo\.?|apartado|b\.\s?p\.|a/ya|box)\s*(?:no\.?|nr\.?|#)?\s*\d+"
_UNIT = r"(?<![\p{L}])(?:suite|ste\.?|apt\.?|apartment|app\.?|of\.|off\.|office|room|unit|flat|kv\.?|kvartyra|top)\s*(?:no\.?|nr\.?|№|#)?\s*\d+\s?[a-z]?(?![\p{L}\d])"
_FLOOR = r"(?<![\d])\d{1,3}\.?\s*(?:st|nd|rd|th)?\s*(?:floor|fl\.|etage|og|piso|planta|poverkh)(?![\p{L}])|(?<![\p{L}])(?:floor|level|etage|piso|planta|stock)\s*\d{1,3}(?!\d)"
_CARE = r"(?:c/o|attn\.?|care of|bldg\.?)\s+[\p{L}][^,;\n\d]*?(?=[,;\n\d]|\s-\s|$)"
_MARK = r"№|#|(?<![\p{L}])(?:bld|nr|no|num)\.?(?=\s*\d)"
_POSTCODE = r"(?<![\p{L}\d])(?:[a-z]{2}-\s?\d{2,6}(?:[ -]\d{2,4})?|[a-z]{1,2}\d{1,2}[a-z]? \d[a-z]{2}|\d{3} \d{2}|\d{2}-\d{3}|\d{4,7})(?![\p{L}\d])"
_HOUSE = r"(?<![\p{L}\d])(\d{1,3}[a-z]?)(?![\p{L}\d])"


def _latin(c: Column) -> Column:
    x = latin(c)
    for a, b in (("ß", "ss"), ("ø", "o"), ("æ", "ae"), ("ł", "l"), ("đ", "d"), ("ı", "i"), ("’", "'")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _without_notes(c: Column) -> Column:
    x = c
    for note in (_CARE, _POST_BOX, _UNIT, _FLOOR):
        x = F.regexp_replace(x, note, " , ")
    return F.regexp_replace(x, _MARK, " ")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"^[a-z]{2}-\s?(?=\d)|[^a-z0-9]", "")


def parsed(rows: DataFrame, key: str) -> DataFrame:
    """(id, house, codes, words, places): what of a row tells its building. Rows without a house number are left out.

    ``places``: texts of a row that may name its country: its columns, and the first and last part of the full address.
    """
    text = {c: _latin(F.col(c)) for c in ("street", "full_address", "city", "country", "region", "place", "country_iso2")}
    whole = _without_notes(F.concat_ws("\n", text["street"], text["full_address"], text["city"], text["place"], text["region"]))
    parts = F.filter(F.transform(F.split(F.coalesce(text["full_address"], F.lit("")), r"[,;\n]|\s-\s"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"\d"))
    ends = F.when(F.size(parts) > 0, F.array(F.element_at(parts, -1), F.element_at(parts, 1))).otherwise(F.array().cast("array<string>"))
    named = F.transform(F.concat(F.array(text["country"], text["country_iso2"]), ends), lambda x: F.trim(x))
    base = rows.select(F.col(key).alias("id"), whole.alias("t"), _without_notes(text["street"]).alias("s"), F.filter(named, lambda x: F.length(x) >= 2).alias("places"))
    spread = F.regexp_replace("t", _POSTCODE, " , ")
    base = base.select("id", "s", "places", F.regexp_extract_all("t", F.lit(f"({_POSTCODE})"), 1).alias("codes"), spread.alias("t"))
    numbers = F.regexp_extract_all("t", F.lit(_HOUSE), 1)
    own = F.regexp_extract_all("s", F.lit(r"(?<![\p{L}\d])(\d{1,5}[a-z]?)(?![\p{L}\d])"), 1)
    letters = F.regexp_extract_all(F.regexp_replace("t", _SUFFIX, " "), F.lit(r"(\p{L}{3,})"), 1)
    stop = F.array(*[F.lit(w) for w in STREET_KINDS + NOTES])
    return (
        base.select(
            "id",
            F.array_sort(F.array_distinct(F.when(F.size(numbers) > 0, numbers).otherwise(own))).alias("house"),
            F.array_sort(F.array_distinct(F.transform("codes", _digits))).alias("codes"),
            F.array_sort(F.array_except(F.array_distinct(letters), stop)).alias("words"),
            "places",
        )
        .where(F.size("house") > 0)
    )


def classes(rows: DataFrame, key: str, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, class_id) and (profiles: class_id, house, tokens, rarest): rows of equal outcome are one class, named by its least id.

    ``tokens``: (token, w) with words, ``z:`` postcodes and ``c:`` countries; w is the rarity over all classes.
    ``rarest``: the rarest word, in most rows the street's name. ``reference``: the list of countries.
    """
    spark = rows.sparkSession
    p = checkpointed(parsed(rows, key))
    # countries as they are typed: by the mapping of free values, once per distinct text
    typed = p.select("id", F.posexplode("places").alias("pos", "place"))
    known = canonical.map_countries(typed, "place", reference).where("code <> '-'").select("place", "code")
    country = typed.join(known, "place").groupBy("id").agg(F.min(F.struct("pos", "code"))["code"].alias("code"), F.collect_set("place").alias("said"))
    p = p.join(country, "id", "left")
    said = F.flatten(F.transform(F.coalesce("said", F.array().cast("array<string>")), lambda x: F.split(x, r"[^\p{L}]+")))
    code = F.when(F.col("code").isNotNull(), F.array(F.concat(F.lit("c:"), "code"))).otherwise(F.array().cast("array<string>"))
    tokens = F.array_sort(F.concat(F.array_except("words", said), F.transform("codes", lambda z: F.concat(F.lit("z:"), z)), code))
    p = p.select("id", F.concat_ws(" ", "house").alias("house"), tokens.alias("tokens")).where(F.exists("tokens", lambda t: ~t.rlike("^[cz]:")))
    p = checkpointed(p.withColumn("profile", F.md5(F.concat_ws("|", "house", F.concat_ws(",", "tokens")).cast("binary"))))
    named = p.groupBy("profile").agg(F.min("id").alias("class_id"), F.first("house").alias("house"), F.first("tokens").alias("tokens"))
    members = p.select("id", "profile").join(named.select("profile", "class_id"), "profile").select("id", "class_id")
    # a country's name left among the words of a row becomes its code
    names = spark.createDataFrame(places.country_names(spark), "c string, token string").where("length(token) > 3").groupBy("token").agg(F.min("c").alias("c"))
    each = named.select("class_id", "house", F.explode("tokens").alias("token")).join(names, "token", "left")
    each = each.select("class_id", "house", F.coalesce(F.concat(F.lit("c:"), "c"), "token").alias("token")).distinct()
    counted = each.groupBy("token").agg(F.count("*").alias("n"))
    total = max(1, named.count())
    weighted = each.join(counted, "token").select("class_id", "house", F.struct("token", F.log(1 + F.lit(float(total)) / F.col("n")).alias("w")).alias("t"))
    profiles = weighted.groupBy("class_id", "house").agg(F.array_sort(F.collect_list("t")).alias("tokens"))
    ranked = F.transform(F.filter("tokens", lambda t: ~t["token"].rlike("^[cz]:")), lambda t: F.struct(t["w"].alias("w"), F.length(t["token"]).alias("n"), t["token"].alias("token")))
    return members, checkpointed(profiles.withColumn("rarest", F.array_max(ranked)["token"]).where("rarest is not null"))


def _block_keys(profiles: DataFrame) -> DataFrame:
    """(class_id, key): each half of each rare word with the house numbers."""
    named = F.filter("tokens", lambda t: ~t["token"].rlike("^[cz]:"))
    ordered = F.transform(F.array_sort(F.transform(named, lambda t: F.struct((-t["w"]).alias("w"), t["token"].alias("token")))), lambda t: F.struct(t["token"].alias("token"), (-t["w"]).alias("w")))
    rare = F.filter(ordered, lambda t: t["w"] >= RARE_PART * ordered[0]["w"])
    halves = F.flatten(F.transform(rare, lambda t: F.array(F.concat(F.lit("<"), F.substring(t["token"], 1, HALF)), F.concat(F.lit(">"), F.right(t["token"], F.lit(HALF))))))
    rows = profiles.select("class_id", "house", F.explode(F.array_distinct(halves)).alias("half"))
    return rows.select("class_id", F.xxhash64("house", "half").alias("key"))


def overlap(a: Column, b: Column, rarest_a: Column, rarest_b: Column) -> Column:
    """Rarity-weighted share of what two rows have in common, words left over being compared by edit distance.

    What only one row says is no contradiction: against the common weight stands the lesser of the two weights left
    over, in which a word counts at most half of the row's largest rarity (it may be a mistyped common word);
    two different countries weigh as much as the rarest word.
    0 if the rarest word of either row is not met in the other.
    """
    ta, tb = F.transform(a, lambda t: t["token"]), F.transform(b, lambda t: t["token"])
    common = F.array_intersect(ta, tb)
    cap = F.greatest(F.array_max(F.transform(a, lambda t: t["w"])), F.array_max(F.transform(b, lambda t: t["w"]))) / 2

    def sim(x: Column, y: Column) -> Column:
        alike = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
        return F.when(x.rlike("^[cz]:") | y.rlike("^[cz]:"), F.when(x.startswith("z:") & y.startswith("z:"), alike).otherwise(0.0)).otherwise(alike)

    def nearest(xs: Column, ys: Column) -> Column:
        """(s, w, m): similarity to the nearest word, own weight, lesser weight of the two."""
        return F.transform(xs, lambda x: F.coalesce(F.array_max(F.transform(ys, lambda y: F.struct(sim(x["token"], y["token"]).alias("s"), x["w"].alias("w"), F.least(x["w"], y["w"]).alias("m")))), F.struct(F.lit(0.0).alias("s"), x["w"].alias("w"), F.lit(0.0).alias("m"))))

    def total(xs: Column, of) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda acc, t: acc + of(t))

    left_a, left_b = F.filter(a, lambda t: ~F.array_contains(common, t["token"])), F.filter(b, lambda t: ~F.array_contains(common, t["token"]))
    na, nb = nearest(left_a, left_b), nearest(left_b, left_a)
    near = lambda t: t["s"] >= WORD_SIMILARITY
    shared = total(F.filter(a, lambda t: F.array_contains(common, t["token"])), lambda t: t["w"])
    shared = shared + F.least(total(F.filter(na, near), lambda t: t["m"] * t["s"]), total(F.filter(nb, near), lambda t: t["m"] * t["s"]))
    against = F.least(total(F.filter(na, lambda t: ~near(t)), lambda t: F.least(t["w"], cap)), total(F.filter(nb, lambda t: ~near(t)), lambda t: F.least(t["w"], cap)))
    lands_a, lands_b = F.filter(ta, lambda t: t.startswith("c:")), F.filter(tb, lambda t: t.startswith("c:"))
    against = against + F.when((F.size(lands_a) > 0) & (F.size(lands_b) > 0) & ~F.arrays_overlap(lands_a, lands_b), 2 * cap).otherwise(0.0)
    has = F.exists(tb, lambda y: sim(rarest_a, y) >= WORD_SIMILARITY) & F.exists(ta, lambda x: sim(rarest_b, x) >= WORD_SIMILARITY)
    return F.when(has, shared / (shared + against)).otherwise(0.0)


def links(profiles: DataFrame, hot: int = HOT_BLOCK, least: float = LEAST_OVERLAP) -> DataFrame:
    """(class_a, class_b, overlap), class_a < class_b, of classes of the same building.

    All classes of a block are compared; a block of more than ``hot`` is cut into parts, and each part meets itself and each other part.
    """
    keys = _block_keys(profiles)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    cut = checkpointed(keys.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")))
    left = cut.select(F.col("class_id").alias("class_a"), "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    right = cut.select(F.col("class_id").alias("class_b"), "key", F.col("part").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["key", "part", "other"]).where("class_a < class_b").select("class_a", "class_b").distinct()
    a = profiles.select(F.col("class_id").alias("class_a"), F.col("tokens").alias("ta"), F.col("rarest").alias("ra"), F.col("house").alias("ha"))
    b = profiles.select(F.col("class_id").alias("class_b"), F.col("tokens").alias("tb"), F.col("rarest").alias("rb"), F.col("house").alias("hb"))
    full = pairs.join(a, "class_a").join(b, "class_b").where("ha = hb")
    return full.select("class_a", "class_b", F.round(overlap(F.col("ta"), F.col("tb"), F.col("ra"), F.col("rb")), 6).alias("overlap")).where(F.col("overlap") >= least)


def with_links(rows: DataFrame, key: str, reference: DataFrame) -> DataFrame:
    """(id, class_id, n_links) of each row with a place: the class of rows of equal outcome, and how many other classes name the same building."""
    members, profiles = classes(rows, key, reference)
    linked = links(profiles).select("class_a", "class_b")
    ends = linked.select(F.col("class_a").alias("class_id")).unionByName(linked.select(F.col("class_b").alias("class_id")))
    return members.join(ends.groupBy("class_id").agg(F.count("*").alias("n")), "class_id", "left").select("id", "class_id", F.coalesce("n", F.lit(0)).alias("n_links"))


def same_building(rows: DataFrame, key: str, reference: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of rows of the same building, rows of one class included.

    Null or blank rows, rows without a house number and rows with only a post box have no pair. The classes with
    their links are the compact form (``classes``, ``links``); this expands them.
    """
    members, profiles = classes(rows, key, reference)
    members = checkpointed(members)
    linked = links(profiles)
    m = members.select(F.col("id").alias("a"), F.col("class_id").alias("class_a"))
    n = members.select(F.col("id").alias("b"), F.col("class_id").alias("class_b"))
    within = m.join(profiles.select(F.col("class_id").alias("class_a")), "class_a").join(n, F.col("class_a") == F.col("class_b")).where("a < b").select("a", "b")
    across = linked.select("class_a", "class_b").join(m, "class_a").join(n, "class_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return within.unionByName(across).distinct()
