"""What is known of each entry of a list, in comparable form: names as words, births, countries, numbers.

All of it is Column expressions. The comparison of two profiles is in ``agreement``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.functions.text import latin
from rosterspark.llm import canonical
from rosterspark.operators import packed
from rosterspark.session import checkpointed, table

# Words that tell no name from another: particles, titles, legal forms, kinds of ship.
PARTICLES = "al el bin ibn bint ben abu umm von van der de la del da dos das el ul".split()
TITLES = "dr prof hon eng he mr mrs ms sir sheikh shaikh sheik lady gen col haji hajji".split()
LEGAL_FORMS = (
    "ltd limited company co corp corporation inc llc llp plc ooo tov oao zao pao gmbh gesmbh gesellschaft mbh ag kg sa sarl societe anonyme sociedad anonima "
    "ab aktiebolag fze fz free zone establishment cie compagnie compania liability as a s bv nv oy"
).split()
VESSEL_WORDS = "mv mt ms ss tanker vessel ship aircraft".split()
PLACEHOLDERS = ["", "-", "--", "unknown", "n a", "na", "none", "tbc", "not stated", "nil", "null"]

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _initials_joined(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?<![a-z])m\s?/\s?v(?![a-z])", "mv")
    return F.regexp_replace(x, r"(?<![a-z])([a-z]{1,3})\.(?=[a-z]{1,4}(?:\.|$|[^a-z]))", "$1")


def _sound(x: Column) -> Column:
    """Spellings of one sound alike; the words keep their blanks."""
    x = F.regexp_replace(F.regexp_replace(x, r"(?<=[a-z])0(?!\d)|(?<!\d)0(?=[a-z])", "o"), r"(?<=[a-z])1(?!\d)|(?<!\d)1(?=[a-z])", "l")
    for a, b in (("ph", "f"), ("kh", "h"), ("tsch", "ch"), ("sch", "sh"), ("tch", "ch"), ("ck", "k"), ("ou", "u"), ("ue", "u"), ("oe", "o"), ("ae", "a"), ("aa", "a"), ("x", "ks")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(F.translate(x, "wyjqz", "viiks"), "c(?!h)", "k")
    x = F.regexp_replace(x, r"([a-z])\1+", "$1")
    return F.regexp_replace(x, r"(?<![a-z])(?:al|el)(?=[a-z]{5})", "")


def name_words(name: Column) -> Column:
    """The telling words of a name, as ``array<string>``, in order, each once; empty for null and placeholders.

    A single letter is an initial and kept; particles, titles and legal forms are left out unless nothing else is there.
    """
    x = latin(name)
    for a, b in (("ß", "ss"), ("ø", "o"), ("æ", "ae"), ("ł", "l"), ("đ", "d"), ("'", ""), ("’", ""), ("`", "")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(_initials_joined(x), r"[^a-z0-9]+", " ")
    x = F.regexp_replace(F.trim(x), r"(?<![a-z0-9])(ra) (?=\d)", "$1")
    plain = F.filter(F.split(x, " "), lambda w: w != "")
    stop = F.array(*[F.lit(w) for w in sorted(set(PARTICLES + TITLES + LEGAL_FORMS + VESSEL_WORDS))])
    kept = F.filter(plain, lambda w: ~F.array_contains(stop, w) | (F.length(w) == 1))
    sounded = F.filter(F.split(F.trim(_sound(F.concat_ws(" ", kept))), " "), lambda w: w != "")
    return F.when(F.trim(x).isin(PLACEHOLDERS), F.array().cast("array<string>")).otherwise(F.array_distinct(sounded))


_BIRTH = "struct<y1:int,y2:int,m:int,d:int>"


def _birth(y1: Column, y2: Column, m: Column, d: Column) -> Column:
    return F.struct(y1.cast("int").alias("y1"), y2.cast("int").alias("y2"), m.cast("int").alias("m"), d.cast("int").alias("d"))


def birth(raw: Column) -> Column:
    """A date of birth as written: years from y1 to y2, month and day if given; null if no year is found.

    ``12/05/1960`` is day first. About a year means two years to either side.
    """
    x = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    none = F.lit(None).cast("int")

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(x, pattern, i).cast("int")

    iso, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$"
    d_mon, mon_d, span = r"^(\d{1,2})\s+([a-z]{3})[a-z]*\.?,?\s+(\d{4})$", r"^([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})$", r"^(\d{4})\s*[-–]\s*(\d{4})$"
    ym, any_year = r"^(\d{4})-(\d{1,2})$", r"(\d{4})"
    months = F.array(*[F.lit(m) for m in _MONTHS])

    def month(pattern: str, i: int) -> Column:
        return F.nullif(F.array_position(months, F.regexp_extract(x, pattern, i)).cast("int"), F.lit(0))

    year = part(any_year, 1)
    about = x.rlike(r"^(~|c\.|ca\.|circa|approx|about|um |vers )")
    return (
        F.when(x.rlike(iso), _birth(part(iso, 1), part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(x.rlike(dmy), _birth(part(dmy, 3), part(dmy, 3), part(dmy, 2), part(dmy, 1)))
        .when(x.rlike(d_mon), _birth(part(d_mon, 3), part(d_mon, 3), month(d_mon, 2), part(d_mon, 1)))
        .when(x.rlike(mon_d), _birth(part(mon_d, 3), part(mon_d, 3), month(mon_d, 1), part(mon_d, 2)))
        .when(x.rlike(span), _birth(part(span, 1), part(span, 2), none, none))
        .when(x.rlike(ym), _birth(part(ym, 1), part(ym, 1), part(ym, 2), none))
        .when(x.rlike(any_year), _birth(F.when(about, year - 2).otherwise(year), F.when(about, year + 2).otherwise(year), none, none))
    )


def kind_of(c: Column) -> Column:
    """P(erson), E(ntity), V(essel), A(ircraft) or null if not known."""
    x = F.lower(F.coalesce(c, F.lit("")))
    return F.when(x.rlike("vessel|ship"), "V").when(x.rlike("aircraft|plane"), "A").when(x.rlike("entity|organi[sz]ation|bolag|company"), "E").when(x.rlike("individual|person"), "P")


def _number(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^(?:passport|id|no\.?|nr\.?)\s+|[^a-z0-9]", "")


def _un_number(c: Column) -> Column:
    x = F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)([a-z]{2}[ei])[\s.\-/]*(\d{3})", 0))
    return F.when(x != "", F.concat(F.lit("un:"), F.regexp_replace(x, "[^A-Z0-9]", "")))


PROFILE = f"entry_id string, source string, kind string, names array<array<string>>, births array<{_BIRTH}>, countries array<string>, numbers array<string>"


def _of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "sanction_record").where("id is not null")
    b = F.transform(
        F.coalesce("birth_dates", F.array().cast(r.schema["birth_dates"].dataType)),
        lambda x: F.when(
            x["birth_year"].isNotNull(),
            _birth(F.when(x["circa"], x["birth_year"] - 2).otherwise(x["birth_year"]), F.when(x["circa"], x["birth_year"] + 2).otherwise(x["birth_year"]), x["birth_month"], x["birth_day"]),
        )
        .when(x["year_range_from"].isNotNull() | x["year_range_to"].isNotNull(), _birth(F.coalesce(x["year_range_from"], x["year_range_to"]), F.coalesce(x["year_range_to"], x["year_range_from"]), F.lit(None), F.lit(None)))
        .otherwise(birth(x["raw"])),
    )
    r = r.select("id", "source", kind_of(F.col("type")).alias("kind"), b.alias("births"), F.coalesce("citizenships", F.array().cast("array<string>")).alias("typed"), F.array_compact(F.array(_un_number(F.col("united_nation_id")))).alias("numbers"))
    r = r.select(F.col("id").alias("entry_id"), "source", "kind", F.lit(None).cast("array<array<string>>").alias("names"), "births", "typed", "numbers")
    # a name is a row of its own: rows of one entry are put together later, once for all
    a = table(spark, sf_dir, "name_alias").where("record_id is not null").select(F.col("record_id").alias("entry_id"), name_words(F.col("whole_name")).alias("n")).where(F.size("n") > 0)
    return r.unionByName(a.select("entry_id", F.array("n").alias("names")), allowMissingColumns=True)


def _of_peps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "test_pep").where("id is not null")
    aliases, dates = packed.unpack(F.col("aliases"), packed.NAMES), packed.unpack(F.col("dates_of_birth"), packed.DATES)
    return t.select(
        F.col("id").alias("entry_id"), F.lit("PEP").alias("source"), kind_of(F.col("type")).alias("kind"),
        F.filter(F.transform(F.concat(F.array("name"), aliases), name_words), lambda n: F.size(n) > 0).alias("names"),
        F.transform(dates, birth).alias("births"),
        packed.unpack(F.col("citizenships"), packed.COUNTRIES).alias("typed"),
        F.transform(packed.unpack(F.col("passports"), packed.NUMBERS), _number).alias("numbers"),
    )


def profiles(spark: SparkSession, sf_dir: str, only_custom: bool = False) -> DataFrame:
    """One profile per entry: rows of the same id (loaded again with other content) are put together.

    ``only_custom``: of the records only those of source CUSTOM. Entries without any name have empty ``names``.
    """
    rows = _of_records(spark, sf_dir).unionByName(_of_peps(spark, sf_dir))
    one = rows.groupBy("entry_id").agg(
        F.min("source").alias("source"), F.mode("kind", True).alias("kind"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"),
        F.filter(F.array_distinct(F.flatten(F.collect_list("births"))), lambda b: b.isNotNull() & b["y1"].isNotNull()).alias("births"),
        F.array_distinct(F.flatten(F.collect_list("typed"))).alias("typed"), F.array_distinct(F.filter(F.flatten(F.collect_list("numbers")), lambda n: F.length(n) >= 5)).alias("numbers"),
    )
    # names of records that do not exist are of no entry
    one = checkpointed(one.where("source in ('CUSTOM', 'PEP')" if only_custom else "source is not null"))
    typed = one.select("entry_id", F.explode("typed").alias("place")).where("place is not null")
    known = canonical.map_countries(typed, "place", table(spark, sf_dir, "country_ref")).where("code <> '-'").select("place", "code")
    lands = typed.join(known, "place").groupBy("entry_id").agg(F.array_sort(F.collect_set("code")).alias("countries"))
    out = one.join(lands, "entry_id", "left").withColumn("countries", F.coalesce("countries", F.array().cast("array<string>")))
    return out.select("entry_id", "source", "kind", "names", "births", "countries", "numbers")
