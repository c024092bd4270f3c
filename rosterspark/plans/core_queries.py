"""Queries of the core operators over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterspark.functions import country, fields, similarity
from rosterspark.functions import text as tx
from rosterspark.operators import export, imports, lookup, overlay, packed, rejects, screening, versions
from rosterspark.session import table
from rosterspark.streaming import limits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


# --- SQL fragments ----------------------------------------------------------------------------------

_LETTERS = "".join(tx.CYRILLIC) + "".join(tx.GREEK)


def sql_norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_latin(c: str) -> str:
    out = f"strip_accents(lower({c}))"
    for k, v in {**tx.CYRILLIC, **tx.GREEK}.items():
        out = f"replace({out}, '{k}', '{v}')"
    return f"case when regexp_matches(strip_accents(lower({c})), '[{_LETTERS}]') then {out} end"


def sql_words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def sql_soundex(w: str) -> str:
    """Codes with H and W left out after the first letter, vowels as 0, runs as one, the first dropped."""
    letters = f"regexp_replace(upper({w}), '[^A-Z]', '', 'g')"
    coded = f"translate(substr({letters}, 1, 1) || regexp_replace(substr({letters}, 2), '[HW]', '', 'g'), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    for d in "0123456":
        coded = f"regexp_replace({coded}, '{d}+', '{d}', 'g')"
    return f"case when {letters} = '' then '' else substr(substr({letters}, 1, 1) || replace(substr({coded}, 2), '0', '') || '000', 1, 4) end"


NAME_WORDS = f"select distinct w from (select unnest({sql_words(sql_norm('whole_name'))}) as w from name_alias)"


def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "name_alias").select(F.explode(tx.words(tx.normalize_text(F.col("whole_name")))).alias("w")).distinct()


# --- Scalar functions -------------------------------------------------------------------------------


@query("fn01_normalize_text", f"select alias_id, {sql_norm('whole_name')} as norm from name_alias")
def fn01(spark, d):
    return t(spark, d, "name_alias").select("alias_id", tx.normalize_text(F.col("whole_name")).alias("norm"))


@query("fn02_transliterate", f"select alias_id, {sql_latin('whole_name')} as latin from name_alias where {sql_latin('whole_name')} is not null")
def fn02(spark, d):
    return t(spark, d, "name_alias").select("alias_id", tx.transliterate(F.col("whole_name")).alias("latin")).where("latin is not null")


@query("fn03_search_tokens", f"""select distinct record_id, token from (
 select record_id, unnest(list_concat({sql_words(sql_norm('whole_name'))}, {sql_words(sql_norm('(' + sql_latin('whole_name') + ')'))})) as token from name_alias) where length(token) >= 2""")  # fmt: skip
def fn03(spark, d):
    names = t(spark, d, "name_alias").groupBy("record_id").agg(F.collect_list("whole_name").alias("n"))
    return names.select("record_id", F.explode(tx.search_tokens(F.col("n"))).alias("token"))


@query("fn04_soundex", f"select w, {sql_soundex('w')} as code from ({NAME_WORDS})")
def fn04(spark, d):
    return name_words(spark, d).select("w", tx.soundex_code(F.col("w")).alias("code"))


_PAIRS = f"""select a.alias_id, {sql_norm('p.whole_name')} as p, {sql_norm('a.whole_name')} as a from name_alias a
 join (select record_id, max_by(whole_name, alias_id) as whole_name from name_alias where pos = 0 group by 1) p using (record_id)"""
_ASCII = "regexp_full_match(p, '[ -~]+') and regexp_full_match(a, '[ -~]+')"


def all_alias_pairs(spark, d):
    a = t(spark, d, "name_alias")
    p = a.where("pos = 0").groupBy("record_id").agg(F.max_by("whole_name", "alias_id").alias("pn"))
    return a.join(p, "record_id").select("alias_id", tx.normalize_text(F.col("pn")).alias("p"), tx.normalize_text(F.col("whole_name")).alias("a"))


def alias_pairs(spark, d):
    return all_alias_pairs(spark, d).where(F.col("p").rlike("^[ -~]+$") & F.col("a").rlike("^[ -~]+$"))


@query("fn05_jaro", f"select alias_id, round(jaro_similarity(p, a), 6) as jaro from ({_PAIRS}) where {_ASCII}")
def fn05(spark, d):
    return alias_pairs(spark, d).select("alias_id", F.round(similarity.jaro_udf("p", "a"), 6).alias("jaro"))


@query("fn06_jaro_winkler", f"select alias_id, round(jaro_winkler_similarity(p, a), 6) as jw from ({_PAIRS}) where {_ASCII}")
def fn06(spark, d):
    return alias_pairs(spark, d).select("alias_id", F.round(similarity.jaro_winkler_udf("p", "a"), 6).alias("jw"))


@query("fn05_jaro_all")
def fn05_all(spark, d):
    """Names of every script; no SQL (that of ``fn05_jaro`` keeps to plain ASCII)."""
    return all_alias_pairs(spark, d).where("p <> '' and a <> ''").select("alias_id", F.round(similarity.jaro_udf("p", "a"), 6).alias("jaro"))


@query("fn06_jaro_winkler_all")
def fn06_all(spark, d):
    """As ``fn05_all``."""
    return all_alias_pairs(spark, d).where("p <> '' and a <> ''").select("alias_id", F.round(similarity.jaro_winkler_udf("p", "a"), 6).alias("jw"))


@query("fn07_word_weight", f"select w, case when w in ('al','bin','ibn','el','abu','van','de') then 0.3 else 1.0 end::double as weight from ({NAME_WORDS})")
def fn07(spark, d):
    return name_words(spark, d).select("w", similarity.word_weight(F.col("w")).cast("double").alias("weight"))


@query("fn08_tokenize", f"""select alias_id, i - 1 as gi, words[i] as word, case when latin[i] is null or latin[i] = words[i] then 1 else 2 end as forms from (
 select alias_id, {sql_words(sql_norm('whole_name'))} as words, {sql_words(sql_norm('(' + sql_latin('whole_name') + ')'))} as latin from name_alias), unnest(range(1, len(words) + 1)) as r(i)""")  # fmt: skip
def fn08(spark, d):
    g = screening.name_groups(t(spark, d, "name_alias").select("alias_id", F.col("pos").alias("ci"), F.col("whole_name").alias("name")), "alias_id")
    return g.groupBy("alias_id", "gi").agg(F.first("first").alias("word"), F.count("*").cast("int").alias("forms")).select("alias_id", F.col("gi").cast("long").alias("gi"), "word", "forms")


def record_names(spark, d):
    """record_id with names in their order as array of structs."""
    a = t(spark, d, "name_alias").select("record_id", "pos", "alias_id", "whole_name")
    return a.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "alias_id", "whole_name"))), lambda x: F.struct(x["whole_name"].alias("whole_name"))).alias("names"))


_NAMES = "select record_id, list(coalesce(whole_name, '') order by pos, alias_id) as n from name_alias group by 1"


@query("fn09_primary_alias", f"select record_id, coalesce(nullif(n[1], ''), 'Unknown Name') as primary_name, array_to_string(n[2:], '|') as aliases from ({_NAMES})")
def fn09(spark, d):
    n = record_names(spark, d)
    return n.select("record_id", fields.primary_name(F.col("names")).alias("primary_name"), F.concat_ws("|", F.transform(fields.alias_names(F.col("names")), lambda x: F.coalesce(x, F.lit("")))).alias("aliases"))


_BIRTHS = """list_filter(list_transform(coalesce(birth_dates, []), lambda b: case when coalesce(b.raw, '') <> '' then b.raw
 when coalesce(b.year_range_from, 0) <> 0 or coalesce(b.year_range_to, 0) <> 0 then coalesce(b.year_range_from::varchar, '?') || '-' || coalesce(b.year_range_to::varchar, '?')
 when coalesce(b.birth_year, 0) <> 0 then concat_ws('-', b.birth_year::varchar, b.birth_month::varchar, b.birth_day::varchar) else '' end), lambda x: x <> '')"""


@query("fn10_birth_text", f"select id as record_id, array_to_string({_BIRTHS}, '; ') as births from sanction_record")
def fn10(spark, d):
    return t(spark, d, "sanction_record").select(F.col("id").alias("record_id"), F.concat_ws("; ", fields.format_births(F.col("birth_dates"))).alias("births"))


def ref_names(spark, d):
    """The country list as a dictionary (country_key, code)."""
    r = t(spark, d, "country_ref")
    rows = r.select(F.explode(F.array("iso2", "iso3", "country_name")).alias("name"), F.col("iso2").alias("code"))
    return rows.select(country.country_key(F.col("name")).alias("country_key"), "code").groupBy("country_key").agg(F.min("code").alias("code"))


def sql_country_key(c: str) -> str:
    return f"regexp_replace(upper(coalesce({c}, '')), '[^A-ZА-ЯЁІЇЄҐ0-9]', '', 'g')"


_DIM = f"select k, min(code) as code from (select {sql_country_key('x')} as k, iso2 as code from (select iso2, unnest([iso2, iso3, country_name]) as x from country_ref)) group by 1"


def sql_code(c: str, rows: str) -> str:
    """``rows`` with code of column ``c``."""
    return f"""select r.*, coalesce(a.code, b.code, case when regexp_full_match(r.k1, '[A-Z]{{2}}') then r.k1 end) as code from
 (select *, {sql_country_key(c)} as k1, {sql_country_key('(' + sql_latin(c) + ')')} as k2 from ({rows})) r left join ({_DIM}) a on r.k1 = a.k left join ({_DIM}) b on r.k2 = b.k"""


@query("fn12_normalize_country", f"select country, code from ({sql_code('country', 'select distinct country from address where country is not null')})")
def fn12(spark, d):
    return country.with_codes(t(spark, d, "address").where("country is not null").select("country").distinct(), "country", "code", ref_names(spark, d))


_PLACES = "select id as record_id, unnest(citizenships) as place from sanction_record union all select record_id, country from address union all select record_id, country_iso2 from address"


@query("fn13_record_countries", f"select record_id, string_agg(distinct code, ',' order by code) as countries from ({sql_code('place', _PLACES)}) where code is not null group by 1")
def fn13(spark, d):
    c = record_countries(spark, d)
    return c.select("record_id", F.concat_ws(",", "countries").alias("countries"))


def record_countries(spark, d):
    a, r = t(spark, d, "address"), t(spark, d, "sanction_record")
    places = r.select(F.col("id").alias("record_id"), F.explode("citizenships").alias("place")).unionByName(a.select("record_id", F.explode(F.array("country", "country_iso2")).alias("place")))
    coded = country.with_codes(places, "place", "code", ref_names(spark, d)).where("code is not null")
    return coded.groupBy("record_id").agg(F.array_sort(F.collect_set("code")).alias("countries"))


@query("fn14_exact_key", r"select row_no, regexp_replace(lower(passports), '[\s-]', '', 'g') as k from test_pep where passports is not null")
def fn14(spark, d):
    return t(spark, d, "test_pep").where("passports is not null").select("row_no", fields.exact_key(F.col("passports")).alias("k"))


@query("fn15_dob_contains", f"select id as record_id from sanction_record where len(list_filter({_BIRTHS}, lambda x: contains(x, '196'))) > 0")
def fn15(spark, d):
    return t(spark, d, "sanction_record").where(fields.matches_birth(F.col("birth_dates"), F.lit("196"))).select(F.col("id").alias("record_id"))


@query("fn16_valid_entity_id", "select v, coalesce(regexp_full_match(v, '[A-Za-z0-9_-]+') and not regexp_full_match(v, '__.*__'), false) as valid from (select distinct split_part(line, ';', 1) as v from pep_raw where not contains(line, chr(10)))")
def fn16(spark, d):
    v = t(spark, d, "pep_raw").where(~F.contains("line", F.lit("\n"))).select(F.split_part("line", F.lit(";"), F.lit(1)).alias("v")).distinct()
    return v.select("v", fields.valid_entity_id(F.col("v")).alias("valid"))


_CONTENT = ["type", "primary_name", "birth_date", "united_nation_id", "programme", "sanction_reason"]


@query("fn17_content_hash", f"select n as rows_of_hash, count(*) as hashes from (select count(*) as n from record_snapshot group by record_id, {', '.join(_CONTENT)}, list_sort(citizenships)) group by 1")
def fn17(spark, d):
    s = t(spark, d, "record_snapshot")
    h = fields.content_hash({**{c: F.col(c) for c in ["record_id", *_CONTENT]}, "citizenships": F.col("citizenships")}, ("citizenships",))
    return s.groupBy(h.alias("h")).agg(F.count("*").alias("n")).groupBy(F.col("n").alias("rows_of_hash")).agg(F.count("*").alias("hashes"))


def sql_csv(c: str) -> str:
    safe = f"case when regexp_matches({c}, '^[=+\\-@\\t\\r]') then '''' || {c} else {c} end"
    return f"""case when coalesce({c}, '') = '' then '' when regexp_matches({safe}, '[",\\r\\n]') then '"' || replace({safe}, '"', '""') || '"' else {safe} end"""


@query("fn18_csv_escape", f"select row_no, {sql_csv('aliases')} as aliases, {sql_csv('passports')} as passports, {sql_csv('full_address')} as full_address from test_pep")
def fn18(spark, d):
    return t(spark, d, "test_pep").select("row_no", *[fields.csv_escape(F.col(c)).alias(c) for c in ("aliases", "passports", "full_address")])


_FULL = "coalesce(nullif(full_address, ''), nullif(concat_ws(', ', nullif(street, ''), nullif(city, ''), nullif(country, '')), ''))"


def sql_time(c: str) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '')"


@query("fn19_csv_rows", f"""select concat_ws(',', {sql_csv('id')}, {sql_csv('source')}, {sql_csv('type')}, {sql_csv("coalesce(nullif(n[1], ''), 'Unknown Name')")}, {sql_csv("array_to_string(n[2:], '; ')")},
 {sql_csv("coalesce(status, 'active')")}, '', '', {sql_csv("array_to_string(" + _BIRTHS + ", '; ')")}, '', {sql_csv("array_to_string(citizenships, '; ')")}, '', {sql_csv("coalesce(addr, '')")}, {sql_csv('sanction_reason')}, '',
 {sql_csv('united_nation_id')}, {sql_csv('eu_ref_number')}, coalesce(nullif({sql_time('listed_at')}, ''), {sql_time('created_at')}), {sql_time('delisted_at')}, {sql_time('updated_at')}) as line
 from sanction_record left join ({_NAMES}) n on id = n.record_id left join (select record_id, string_agg({_FULL}, '; ' order by address_id) as addr from address group by 1) a on id = a.record_id""")  # fmt: skip
def fn19(spark, d):
    return export.csv_lines(export_rows(spark, d)).select("line")


def export_rows(spark, d):
    """Records with names and addresses, as the export takes them."""
    r = t(spark, d, "sanction_record").withColumnRenamed("id", "record_id")
    a = t(spark, d, "address").groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("address_id", "street", "city", "country", "full_address"))), lambda x: F.struct(x["street"].alias("street"), x["city"].alias("city"), x["country"].alias("country"), x["full_address"].alias("full_address"))).alias("addresses"))
    return r.join(record_names(spark, d), "record_id", "left").join(a, "record_id", "left")


@query("fn20_redact_email", r"select row_no, regexp_replace('from ' || id || '@lists.example.org, ' || coalesce(name, ''), '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', '\1***\2', 'g') as line from test_pep")
def fn20(spark, d):
    line = F.concat(F.lit("from "), "id", F.lit("@lists.example.org, "), F.coalesce("name", F.lit("")))
    return t(spark, d, "test_pep").select("row_no", fields.redact_emails(line).alias("line"))


@query("fn22_token_fields", "select id, sha256(id) as hash, split_part(id, '_', 1) || '_...' || right(id, 4) as preview from (select distinct id from test_pep where id is not null)")
def fn22(spark, d):
    return t(spark, d, "test_pep").where("id is not null").select("id").distinct().select("id", fields.token_hash(F.col("id")).alias("hash"), fields.token_preview(F.col("id")).alias("preview"))


@query("fn24_stable_id", "select row_no, 'sub_' || substr(sha256(coalesce(id, '') || chr(31) || coalesce(name, '')), 1, 16) as subject_id from test_pep")
def fn24(spark, d):
    return t(spark, d, "test_pep").select("row_no", fields.stable_id("sub", F.col("id"), F.col("name")).alias("subject_id"))


# --- Filters ----------------------------------------------------------------------------------------


@query("flt01_search_filters", "select id as record_id from sanction_record where coalesce(status, 'active') <> 'delisted' and source in ('EU', 'UN') and type = 'individual'")
def flt01(spark, d):
    r = t(spark, d, "sanction_record").withColumnRenamed("id", "record_id")
    return screening.keep_records(r, screening.Options(source="eu, UN", type="Individual")).select("record_id")


@query("flt02_export_filters", "select id as record_id from sanction_record where status = 'delisted' and source = 'EU' and 'import_eu_05' in (first_seen_import, last_seen_import) and type is not null")
def flt02(spark, d):
    r = t(spark, d, "sanction_record").withColumnRenamed("id", "record_id")
    return export.export_filter(r, status="delisted", source="EU", import_id="import_eu_05").select("record_id")


@query("flt03_drop_custom", "select source, count(*) as n from sanction_record where source <> 'CUSTOM' group by 1")
def flt03(spark, d):
    return versions.drop_custom(t(spark, d, "sanction_record")).groupBy("source").agg(F.count("*").alias("n"))


@query("flt04_equality_filters", "select row_no from test_pep where source = 'PEP' and type = 'individual'")
def flt04(spark, d):
    return t(spark, d, "test_pep").where("source = 'PEP' and type = 'individual'").select("row_no")


@query("flt07_query_lines", "select row_no, trim(name) as name from test_pep where trim(coalesce(name, '')) <> '' and not starts_with(trim(name), '#')")
def flt07(spark, d):
    return t(spark, d, "test_pep").select("row_no", F.trim("name").alias("name")).where("name <> '' and not startswith(name, '#')")


@query("flt08_newest_log_lines", "select event_id, event_type from events where event_type in ('error', 'purchase') order by ts desc, event_id desc limit 100")
def flt08(spark, d):
    return t(spark, d, "events").where(F.col("event_type").isin("error", "purchase")).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type")


# --- Joins ------------------------------------------------------------------------------------------

_UN = r"regexp_replace(lower(united_nation_id), '[\s-]', '', 'g')"


@query("jn03_exact_id", f"select a.id as q_id, b.id as record_id from (select id, {_UN} as k from sanction_record) a join (select id, {_UN} as k from sanction_record) b using (k) where length(k) >= 4")
def jn03(spark, d):
    r = t(spark, d, "sanction_record")
    return screening.id_hits(r.select(F.col("id").alias("q_id"), F.col("united_nation_id").alias("name")), r.select(F.col("id").alias("record_id"), F.col("united_nation_id").alias("number")))


def overrides(spark, d):
    """An override for every thirteenth record by its digits: a programme, and the reason set to nothing."""
    r = t(spark, d, "sanction_record")
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    return r.where(n % 13 == 0).select("id", F.array(F.lit("programme"), F.lit("sanction_reason"), F.lit("source")).alias("present"), F.lit("REVIEWED").alias("programme"), F.lit(None).cast("string").alias("sanction_reason"), F.lit("X").alias("source"))


_NO = r"regexp_extract(id, '(\d+)$', 1)::bigint"


@query("jn04_override_overlay", f"""select id, source, case when {_NO} % 13 = 0 then 'REVIEWED' else programme end as programme, case when {_NO} % 13 = 0 then null else sanction_reason end as sanction_reason,
 case when {_NO} % 13 = 0 then 'programme,sanction_reason' else '' end as overridden from sanction_record""")  # fmt: skip
def jn04(spark, d):
    r = t(spark, d, "sanction_record").select("id", "source", "programme", "sanction_reason")
    return overlay.apply_overrides(r, overrides(spark, d), "id").withColumn("overridden", F.concat_ws(",", "overridden"))


def decisions(spark, d):
    """Decisions on every third record, for subjects S0 to S4, some of them outdated."""
    r = t(spark, d, "sanction_record")
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    rows = r.where(n % 3 == 0).select(F.col("id").alias("record_id"), F.concat(F.lit("S"), (n % 5).cast("string")).alias("subject_id"), n.alias("n"), F.md5("id").alias("current_hash"))
    return rows.select(
        "record_id", "subject_id", F.when(F.col("n") % 2 == 0, "false_positive").otherwise("true_match").alias("verdict"), F.when(F.col("n") % 5 == 1, F.to_timestamp(F.lit("2024-01-01"))).alias("expires_at"),
        F.when(F.col("n") % 7 == 0, "other").when(F.col("n") % 11 != 0, F.col("current_hash")).alias("decided_hash"), "current_hash",
    )


_DECISIONS = f"""select id as record_id, 'S' || ({_NO} % 5) as subject_id, case when {_NO} % 2 = 0 then 'false_positive' else 'true_match' end as verdict,
 case when {_NO} % 2 <> 0 then 'not_whitelisted' when {_NO} % 5 = 1 then 'invalidated_expired' when {_NO} % 7 = 0 then 'invalidated_data_changed' else 'valid' end as validity from sanction_record where {_NO} % 3 = 0"""


def judged_decisions(spark, d):
    return decisions(spark, d).withColumn("validity", overlay.decision_validity(F.col("verdict"), F.col("expires_at"), F.col("decided_hash"), F.col("current_hash"), F.to_timestamp(F.lit("2024-06-01"))))


@query("dml09_decision_validity", f"select * from ({_DECISIONS})")
def dml09(spark, d):
    return judged_decisions(spark, d).select("record_id", "subject_id", "verdict", "validity")


def sample_hits(spark, d):
    """A hit of every record for subject S0 or S1, with a score from its digits."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    return t(spark, d, "sanction_record").select(F.concat(F.lit("S"), (n % 2).cast("string")).alias("subject_id"), F.concat(F.lit("S"), (n % 2).cast("string")).alias("q_id"), F.col("id").alias("record_id"), (60 + n % 41).cast("int").alias("score"), (n % 97 == 0).alias("id_hit"))


_HITS = f"select 'S' || ({_NO} % 2) as subject_id, id as record_id, (60 + {_NO} % 41)::int as score, {_NO} % 97 = 0 as id_hit from sanction_record"


@query("jn05_decision_lookup", f"select h.subject_id, h.record_id, h.score, d.verdict, coalesce(d.validity = 'valid', false) as auto_cleared from ({_HITS}) h left join ({_DECISIONS}) d using (record_id, subject_id)")
def jn05(spark, d):
    return screening.with_decisions(sample_hits(spark, d), judged_decisions(spark, d)).select("subject_id", "record_id", "score", "verdict", "auto_cleared")


@query("flt06_suppress_fp", f"select h.subject_id, h.record_id from ({_HITS}) h left join ({_DECISIONS}) d using (record_id, subject_id) where coalesce(d.validity, '') <> 'valid'")
def flt06(spark, d):
    return screening.with_decisions(sample_hits(spark, d), judged_decisions(spark, d), suppress=True).select("subject_id", "record_id")


@query("ag08_screening_summary", f"""select h.subject_id, count(*) as matches, count(*) filter (where coalesce(d.validity, '') = 'valid') as auto_cleared, count(*) filter (where coalesce(d.validity, '') <> 'valid') as new_alerts, max(score) as best
 from ({_HITS}) h left join ({_DECISIONS}) d using (record_id, subject_id) where score >= 70 group by 1""")  # fmt: skip
def ag08(spark, d):
    hits = screening.with_decisions(sample_hits(spark, d).where(F.col("score") >= screening.PORTFOLIO_THRESHOLD), judged_decisions(spark, d))
    return export.run_summary(hits)


@query("tk01_topk_per_query", f"""select subject_id, record_id, score, rank, total_matches, total_matches > 20 as truncated from (select *, row_number() over (partition by subject_id order by score desc, id_hit desc, record_id) as rank,
 count(*) over (partition by subject_id)::int as total_matches from ({_HITS})) where rank <= 20""")  # fmt: skip
def tk01(spark, d):
    return screening.ranked(sample_hits(spark, d), screening.LIMIT).select("subject_id", "record_id", "score", F.col("rank").cast("long").alias("rank"), "total_matches", "truncated")


@query("ag09_total_and_truncated", f"select subject_id, count(*) as total, count(*) > 20 as truncated from ({_HITS}) group by 1")
def ag09(spark, d):
    return sample_hits(spark, d).groupBy("subject_id").agg(F.count("*").alias("total"), (F.count("*") > screening.LIMIT).alias("truncated"))


@query("sim06_07_corroboration", f"""select h.record_id, case when c.countries is null then 'no_candidate_data' when list_contains(c.countries, 'DE') then 'match' else 'mismatch' end as status,
 least(100, greatest(0, score + case when b.record_id is not null then 10 else 0 end + case when c.countries is null then 0 when list_contains(c.countries, 'DE') then 10 else -20 end))::int as final from ({_HITS}) h
 left join (select record_id, list(distinct code) as countries from ({sql_code('place', _PLACES)}) where code is not null group by 1) c using (record_id)
 left join (select id as record_id from sanction_record where len(list_filter({_BIRTHS}, lambda x: contains(x, '196'))) > 0) b using (record_id)""")  # fmt: skip
def sim0607(spark, d):
    r = t(spark, d, "sanction_record").select(F.col("id").alias("record_id"), "birth_dates")
    j = sample_hits(spark, d).join(r, "record_id").join(record_countries(spark, d), "record_id", "left")
    status = country.country_status(F.lit("DE"), F.col("countries"))
    born = F.when(fields.matches_birth(F.col("birth_dates"), F.lit("196")), screening.BIRTH_POINTS).otherwise(0)
    return j.select("record_id", status.alias("status"), F.least(F.lit(100), F.greatest(F.lit(0), F.col("score") + born + country.country_points(status))).cast("int").alias("final"))


@query("jn11_event_subscriptions", "select event_id, s from events, unnest(case when event_type = 'error' then ['all', 'errors'] when event_type = 'purchase' then ['all', 'sales'] else ['all'] end) as u(s)")
def jn11(spark, d):
    subs = spark.createDataFrame([("all", ["*"]), ("errors", ["error", "error"]), ("sales", ["purchase"])], "subscription_id string, events array<string>")
    return overlay.subscribed(t(spark, d, "events").select("event_id", "event_type"), subs).select("event_id", F.col("subscription_id").alias("s"))


# --- Word scores ------------------------------------------------------------------------------------

_W3 = f"select w, substr(w, 1, 3) as p, {sql_soundex('w')} as sx from ({NAME_WORDS}) where regexp_full_match(w, '[a-z]+')"


@query("sim01_pair_score", f"""select a, b, round(case when a = b then 1.0 when not same and m < 3 then 0.0 when substr(a,1,1) <> substr(b,1,1) and sa <> '' and substr(sa,2) = substr(sb,2) and (substr(a,2) = substr(b,2) or jw >= 0.95) then 0.92
 else greatest(case when same then case when adj >= 0.8 then 0.9 else 0.5 end else 0.0 end, case when m >= 3 and adj >= case when m <= 6 then 0.9 else 0.75 end then adj else 0.0 end) end, 6) as score from (
 select *, case when substr(a,1,1) = substr(b,1,1) then jw else jw * 0.9 end as adj from (select x.w as a, y.w as b, x.sx as sa, y.sx as sb, x.sx = y.sx and x.sx <> '' as same, least(length(x.w), length(y.w)) as m, jaro_winkler_similarity(x.w, y.w) as jw
 from ({_W3}) x join ({_W3}) y using (p) where x.w <= y.w))""")  # fmt: skip
def sim01(spark, d):
    """Pairs of words with the same first three letters."""
    w = name_words(spark, d).where(F.col("w").rlike("^[a-z]+$")).withColumn("p", F.substring("w", 1, 3)).withColumn("s", tx.soundex_code(F.col("w")))
    x, y = w.select("p", F.col("w").alias("a"), F.col("s").alias("sa")), w.select("p", F.col("w").alias("b"), F.col("s").alias("sb"))
    j = x.join(y, "p").where("a <= b").withColumn("jw", similarity.jaro_winkler_udf("a", "b"))
    return j.select("a", "b", F.round(similarity.pair_score(F.col("a"), F.col("b"), F.col("sa"), F.col("sb"), F.col("jw")), 6).alias("score"))


# --- Aggregations -----------------------------------------------------------------------------------


@query("ag01_counts_by_source", "select source, count(*) as records, count(*) filter (where coalesce(status, 'active') <> 'delisted') as active, count(*) filter (where status = 'delisted') as delisted from sanction_record group by 1")
def ag01(spark, d):
    return export.counts_by_source(t(spark, d, "sanction_record"))


@query("ag02_sources", "select distinct source from sanction_record order by 1")
def ag02(spark, d):
    return t(spark, d, "sanction_record").select("source").distinct().orderBy("source")


def snapshot(spark, d, number: int) -> DataFrame:
    """One delivery of all sources: last row of each record, with its content hash."""
    s = t(spark, d, "record_snapshot").where(F.col("snapshot_no") == number)
    h = F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in _CONTENT]))
    last = s.groupBy(F.col("record_id").alias("id")).agg(F.max_by(F.struct("source", "status", h.alias("content_hash"), "line_no"), "line_no").alias("v"))
    return last.select("id", "v.source", "v.status", "v.content_hash", F.col("v.line_no").alias("ord"))


def sql_snapshot(number: int) -> str:
    return f"select record_id as id, source, status, md5(concat_ws('|', {', '.join(f'coalesce({c}, {chr(39)}{chr(39)})' for c in _CONTENT)})) as h, line_no as ord from record_snapshot where snapshot_no = {number} qualify row_number() over (partition by record_id order by line_no desc) = 1"


_CHANGE = "case when s.id is null then 'added' when coalesce(s.status, 'active') = 'delisted' then 'updated' when s.h = i.h then 'unchanged' else 'updated' end"
_DIFF = f"select i.id, {_CHANGE} as change, i.ord from ({sql_snapshot(5)}) i left join ({sql_snapshot(1)}) s using (id)"
_GONE = f"select s.id from ({sql_snapshot(1)}) s where coalesce(s.status, 'active') <> 'delisted' and source <> 'CUSTOM' and s.id not in (select id from ({sql_snapshot(5)}))"


@query("jn06_snapshot_diff", f"select id, change from ({_DIFF})")
def jn06(spark, d):
    return versions.classify(snapshot(spark, d, 5), snapshot(spark, d, 1)).select("id", "change")


@query("jn07_delist_set", _GONE)
def jn07(spark, d):
    return versions.to_delist(snapshot(spark, d, 5), snapshot(spark, d, 1))


@query("ag03_diff_counts", f"""select (select count(*) from ({_DIFF})) as parsed, count(*) filter (where change = 'added') as added, count(*) filter (where change = 'updated') as updated, count(*) filter (where change = 'unchanged') as unchanged,
 (select count(*) from ({_GONE})) as delisted, 0 as skipped from ({_DIFF})""")  # fmt: skip
def ag03(spark, d):
    return versions.diff_counts(snapshot(spark, d, 5), snapshot(spark, d, 1)).select("parsed", "added", "updated", "unchanged", "delisted", "skipped")


@query("ag05_delist_ratio", f"""select active_count, round(case when active_count > 0 then delisted / active_count else 0 end, 6) as delist_ratio, active_count > 0 and delisted / active_count > 0.2 as guard_tripped from
 (select (select count(*) from ({sql_snapshot(1)}) where coalesce(status, 'active') <> 'delisted') as active_count, (select count(*) from ({_GONE})) as delisted)""")  # fmt: skip
def ag05(spark, d):
    return versions.diff_counts(snapshot(spark, d, 5), snapshot(spark, d, 1)).select("active_count", "delist_ratio", "guard_tripped")


@query("ag04_bucket_samples", f"select change, id, n from (select *, row_number() over (partition by change order by ord, id) as n from ({_DIFF})) where n <= 5")
def ag04(spark, d):
    s = versions.samples(versions.classify(snapshot(spark, d, 5), snapshot(spark, d, 1)))
    return s.withColumn("n", F.col("n").cast("long"))


def stored_state(spark, d):
    s = snapshot(spark, d, 1)
    at = F.to_timestamp(F.lit("2023-11-15"))
    return s.select("id", "source", "status", "content_hash", at.alias("listed_at"), F.when(F.col("status") == "delisted", at).alias("delisted_at"), F.lit("{}").alias("body"), at.alias("created_at"), at.alias("updated_at"))


def incoming_state(spark, d):
    return snapshot(spark, d, 5).select("id", "source", "status", F.lit(None).cast("timestamp").alias("listed_at"), "content_hash", F.lit("{}").alias("body"), "ord")


def imported(spark, d):
    return versions.upsert(incoming_state(spark, d), stored_state(spark, d), F.to_timestamp(F.lit("2024-03-14")), "import_05", delist=True)


_WAS, _WILL = "coalesce(s.status, 'active')", "coalesce(i.status, 'active')"
_UPSERT = f"""select id, i.h as ih, s.h as sh, i.status as istatus, s.status as sstatus, case when i.h is null then case when {_WAS} <> 'delisted' and s.source <> 'CUSTOM' then 'delisted' else 'kept' end when s.h is null then 'created'
 when {_WAS} = 'delisted' and {_WILL} <> 'delisted' then 'relisted' when {_WAS} <> 'delisted' and {_WILL} = 'delisted' then 'delisted' when i.h = s.h then 'unchanged' else 'updated' end as change_type
 from ({sql_snapshot(5)}) i full outer join ({sql_snapshot(1)}) s using (id)"""


@query("dml04_upsert_classes", f"select id, change_type from ({_UPSERT})")
def dml04(spark, d):
    return imported(spark, d).select("id", "change_type")


@query("dml05_soft_delete", f"""select id, case when change_type = 'delisted' then 'delisted' when change_type = 'created' then coalesce(istatus, 'active') when change_type = 'relisted' then 'active' else coalesce(sstatus, 'active') end as status,
 (case when change_type = 'delisted' then timestamp '2024-03-14' when change_type in ('relisted', 'created') then null when sstatus = 'delisted' then timestamp '2023-11-15' end) as delisted_at from ({_UPSERT})""")  # fmt: skip
def dml05(spark, d):
    return versions.new_state(imported(spark, d)).select("id", "status", "delisted_at")


@query("dml06_version_trail", f"select id, 'import_05' as import_id, change_type from ({_UPSERT}) where change_type not in ('unchanged', 'kept')")
def dml06(spark, d):
    return versions.version_rows(imported(spark, d)).select("id", "import_id", "change_type")


@query("ag06_skip_reasons")
def ag06(spark, d):
    """No SQL: reasons come from the line parser."""
    return rejects.rejected(rejects.parse_uploads(t(spark, d, "pep_raw"))).groupBy("reason").agg(F.count("*").alias("n"))


_DELIVERED = "select source, import_id, count(*) as uploaded from record_snapshot group by 1, 2"


@query("ag07_max_per_source", f"select coalesce(source, 'all') as source, sum(n)::bigint as records from (select l.source, max(coalesce(uploaded, 0)) as n from import_log l left join ({_DELIVERED}) u using (source, import_id) where l.status = 'applied' group by 1) group by rollup (source)")
def ag07(spark, d):
    up = t(spark, d, "record_snapshot").groupBy("source", "import_id").agg(F.count("*").alias("uploaded"))
    return export.records_per_source(t(spark, d, "import_log").join(up, ["source", "import_id"], "left"))


@query("ag10_import_totals", f"select trigger_kind, count(*) as imports, sum(coalesce(uploaded, 0))::bigint as records from import_log left join ({_DELIVERED}) u using (source, import_id) group by 1")
def ag10(spark, d):
    up = t(spark, d, "record_snapshot").groupBy("source", "import_id").agg(F.count("*").alias("uploaded"))
    return t(spark, d, "import_log").join(up, ["source", "import_id"], "left").groupBy("trigger_kind").agg(F.count("*").alias("imports"), F.sum(F.coalesce("uploaded", F.lit(0))).alias("records"))


@query("ag12_percentile", """select event_type, round(max(value) filter (where i = floor(n * 0.5)), 6) as p50, round(max(value) filter (where i = floor(n * 0.95)), 6) as p95 from
 (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null) group by 1""")  # fmt: skip
def ag12(spark, d):
    return export.percentiles(t(spark, d, "events").where("value is not null"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("ag13_status_counts", "select source, count(*) filter (where status = 'applied') as applied, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'rejected') as rejected from import_log group by 1")
def ag13(spark, d):
    return t(spark, d, "import_log").groupBy("source").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("applied", "failed", "rejected")])


# --- Sorts, sets ------------------------------------------------------------------------------------


@query("tk03_newest_first", "select import_id, uploaded_at from import_log order by uploaded_at desc, import_id limit 20")
def tk03(spark, d):
    return t(spark, d, "import_log").orderBy(F.desc("uploaded_at"), "import_id").limit(20).select("import_id", "uploaded_at")


@query("tk04_resort", f"select record_id, score, row_number() over (order by score, record_id desc) as place from ({_HITS}) order by score, record_id desc limit 100")
def tk04(spark, d):
    top = sample_hits(spark, d).orderBy("score", F.desc("record_id")).limit(100)
    return top.select("record_id", "score", F.row_number().over(Window.orderBy("score", F.desc("record_id"))).cast("long").alias("place"))


@query("set01_union_sources", "select src, count(*) as n, count(distinct id) as ids from (select source as src, id from sanction_record union all select 'PEP', id from test_pep) group by 1")
def set01(spark, d):
    both = t(spark, d, "sanction_record").select(F.col("source").alias("src"), "id", "programme").unionByName(t(spark, d, "test_pep").select(F.lit("PEP").alias("src"), "id"), allowMissingColumns=True)
    return both.groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("set03_difference", "select distinct record_id from record_snapshot where snapshot_no = 1 except select record_id from record_snapshot where snapshot_no = 5")
def set03(spark, d):
    s = t(spark, d, "record_snapshot")
    return s.where("snapshot_no = 1").select("record_id").distinct().join(s.where("snapshot_no = 5").select("record_id"), "record_id", "left_anti")


@query("set04_array_distinct_union", "select record_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(citizenships, []))))), ',') as lands from record_snapshot group by 1")
def set04(spark, d):
    s = t(spark, d, "record_snapshot").groupBy("record_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("citizenships", F.array().cast("array<string>"))))).alias("l"))
    return s.select("record_id", F.concat_ws(",", F.array_sort(F.array_compact("l"))).alias("lands"))


# --- Logs -------------------------------------------------------------------------------------------


def override_log(spark, d):
    """Events as an override log: users are records, errors delete."""
    e = t(spark, d, "events")
    return e.select("user_id", "event_id", F.when(F.col("event_type") == "error", "deleted").otherwise("saved").alias("action"), F.col("event_type").alias("content"))


_LOG = "select user_id, event_id, case when event_type = 'error' then 'deleted' else 'saved' end as action, event_type as content from events"


@query("dml07_override_history", f"""select user_id, event_id, case when action = 'deleted' then 'deleted' when b is null or b = 'deleted' then 'created' else 'replaced' end as change from
 (select *, lag(action) over (partition by user_id order by event_id) as b from ({_LOG})) where action <> 'deleted' or (b is not null and b <> 'deleted')""")  # fmt: skip
def dml07(spark, d):
    return overlay.override_history(override_log(spark, d), ["user_id"], "event_id", "action").select("user_id", "event_id", "change")


@query("dml08_decision_current", f"select user_id, event_id, content from ({_LOG}) qualify row_number() over (partition by user_id order by event_id desc) = 1 and action <> 'deleted'")
def dml08(spark, d):
    log = override_log(spark, d).withColumn("seq", F.col("event_id"))
    return overlay.latest(log, ["user_id"], "seq", "action").select("user_id", "event_id", "content")


@query("dml10_custom_records", """select source, count(*) as n, count(*) filter (where programme = 'NEW') as fresh, count(*) filter (where sanction_reason = 'patched') as patched from (
 select source, programme, case when source = 'EU' then 'patched' else sanction_reason end as sanction_reason from sanction_record where not (source = 'CUSTOM' and type = 'entity')
 union all select 'CUSTOM', 'NEW', null from test_pep where id is not null group by id) group by 1""")  # fmt: skip
def dml10(spark, d):
    r = t(spark, d, "sanction_record").select("id", "source", "type", "programme", "sanction_reason")
    new = t(spark, d, "test_pep").where("id is not null").select("id").distinct().select("id", F.lit("CUSTOM").alias("source"), F.lit("individual").alias("type"), F.lit("NEW").alias("programme"), F.lit(None).cast("string").alias("sanction_reason"))
    inserted = overlay.insert_missing(r, new.unionByName(r), "id")
    patched = overlay.patch(inserted, r.where("source = 'EU'").select("id", F.lit("patched").alias("sanction_reason")), "id")
    left = overlay.delete_custom(patched, r.where("type = 'entity'").select("id"), "id")
    return left.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("programme") == "NEW").alias("fresh"), F.count_if(F.col("sanction_reason") == "patched").alias("patched"))


@query("dml11_import_state", "select import_id, status, status in ('failed', 'rejected') as retry from import_log")
def dml11(spark, d):
    log = t(spark, d, "import_log").select("import_id", "status", F.coalesce("finished_at", "uploaded_at").alias("at"))
    pending = t(spark, d, "import_log").select("import_id", F.lit("pending").alias("status"), (F.col("uploaded_at") - F.expr("interval 1 second")).alias("at"))
    return overlay.import_state(log.unionByName(pending), F.to_timestamp(F.lit("2024-06-01"))).select("import_id", "status", "retry")


@query("dml13_subject_validation", """select row_no, case when trim(coalesce(name, '')) = '' then 'name is required' when not coalesce(regexp_full_match(id, '[A-Za-z0-9_-]+') and not regexp_full_match(id, '__.*__'), false) then 'customer id is invalid' end as error from test_pep""")
def dml13(spark, d):
    return overlay.checked_subjects(t(spark, d, "test_pep").select("row_no", "name", F.col("id").alias("customer_id"))).select("row_no", "error")


@query("dml14_resolve_alert", f"select record_id, case when {_NO.replace('id,', 'record_id,')} % 4 = 0 then 'dismissed' when {_NO.replace('id,', 'record_id,')} % 4 = 1 then 'confirmed' else 'open' end as status from ({_HITS})")
def dml14(spark, d):
    a = overlay.alerts(sample_hits(spark, d).withColumn("auto_cleared", F.lit(False)))
    n = F.regexp_extract("record_id", r"(\d+)$", 1).cast("long")
    verdicts = a.where(n % 4 < 2).select("alert_id", F.when(n % 4 == 0, "false_positive").otherwise("true_match").alias("verdict"), F.lit("me").alias("decided_by"))
    return overlay.resolve_alerts(a, verdicts)[0].select("record_id", "status")


# --- Screening: no SQL, tested against brute force --------------------------------------------------


def screening_inputs(spark, d):
    """The PEP list as queries (first date of birth, country of the first citizenship) against all records."""
    first = lambda c, rule: F.get(packed.unpack(F.col(c), rule), F.lit(0))
    pep = t(spark, d, "test_pep").where("name is not null").select(F.col("row_no").alias("q_id"), "name", first("dates_of_birth", packed.DATES).alias("dob"), first("citizenships", packed.COUNTRIES).alias("land"))
    queries = country.with_codes(pep, "land", "country", ref_names(spark, d)).select("q_id", "name", F.nullif(F.trim("dob"), F.lit("")).alias("dob"), "country")
    r = t(spark, d, "sanction_record").withColumnRenamed("id", "record_id").join(record_countries(spark, d), "record_id", "left").select("record_id", "source", "type", "status", "birth_dates", "countries")
    names = t(spark, d, "name_alias").where("whole_name is not null").select("record_id", F.col("pos").alias("ci"), F.col("whole_name").alias("name")).distinct()
    numbers = t(spark, d, "sanction_record").where("united_nation_id is not null").select(F.col("id").alias("record_id"), F.col("united_nation_id").alias("number"))
    return queries, r, names, numbers


@query("flagship_portfolio_screening")
def flagship(spark, d):
    q, r, n, numbers = screening_inputs(spark, d)
    hits = screening.screen(q, r, n, screening.Options(threshold=screening.PORTFOLIO_THRESHOLD), numbers)
    return screening.ranked(hits, screening.LIMIT)


@query("sim05_best_alias")
def sim05(spark, d):
    q, _, n, _ = screening_inputs(spark, d)
    return screening.name_scores(q, n, least=screening.THRESHOLD)


@query("snk06_result_lines")
def snk06(spark, d):
    """The shown results of the whole portfolio as lines of nine columns."""
    q, r, n, numbers = screening_inputs(spark, d)
    shown = screening.ranked(screening.screen(q, r, n, screening.Options(threshold=screening.PORTFOLIO_THRESHOLD), numbers), screening.LIMIT)
    return export.result_lines(shown, r.join(record_names(spark, d), "record_id", "left"))


@query("snk01_search_summary")
def snk01(spark, d):
    q, r, n, numbers = screening_inputs(spark, d)
    hits = screening.screen(q, r, n, screening.Options(threshold=screening.PORTFOLIO_THRESHOLD), numbers)
    return export.search_summary(q, hits, ["US", "EU", "UK", "UN", "CH", "UA", "CUSTOM"], screening.LIMIT)


@query("sim09_explain")
def sim09(spark, d):
    """All hits that the screening lists, at its own threshold and limit."""
    q, r, n, numbers = screening_inputs(spark, d)
    hits = screening.screen(q, r, n, screening.Options(threshold=screening.PORTFOLIO_THRESHOLD), numbers)
    return screening.explain(screening.ranked(hits, screening.LIMIT), q)


@query("jn01_blocking_recall_gap")
def jn01(spark, d):
    """Per mode the hits of all queries: the reference's keys against the lossless ones."""
    q, _, n, _ = screening_inputs(spark, d)
    out = [screening.name_scores(q, n, m, screening.THRESHOLD).agg(F.count("*").alias("hits")).withColumn("mode", F.lit(m)) for m in ("reference", "lossless")]
    return out[0].unionByName(out[1])


@query("ag11_calibration_recall")
def ag11(spark, d):
    """Recall per query source: a record's own alias must find it."""
    n = t(spark, d, "name_alias").where("whole_name is not null").select("record_id", F.col("pos").alias("ci"), F.col("whole_name").alias("name"), "alias_id").distinct()
    asked = n.where("ci > 0 and trim(name) <> ''").select(F.col("alias_id").alias("q_id"), "name", F.col("record_id").alias("expected"))
    found = screening.name_scores(asked.select("q_id", "name"), n.where("ci = 0").select("record_id", "ci", "name"), least=screening.THRESHOLD)
    return export.recall(asked, found)


# --- Lookups and imports ----------------------------------------------------------------------------


@query("src14_projected_scan", "select id, coalesce(status, 'active') as status, programme from sanction_record where source = 'EU'")
def src14(spark, d):
    r = lookup.scan(t(spark, d, "sanction_record"), "EU", ["id", "status", "programme"])
    return r.withColumn("status", F.coalesce("status", F.lit("active")))


@query("src15_multi_get", f"""select a.record_id, r.id is not null as found, case when {_NO} % 13 = 0 then 'Reviewed' else r.programme end as programme, r.status
 from (select distinct record_id from documents where record_id is not null) a left join sanction_record r on a.record_id = r.id""")  # fmt: skip
def src15(spark, d):
    """The records that documents speak of, each once, with an analyst's override on some."""
    r = t(spark, d, "sanction_record").select(F.col("id").alias("record_id"), "programme", "status")
    n = F.regexp_extract("record_id", r"(\d+)$", 1).cast("long")
    o = r.where(n % 13 == 0).select("record_id", F.array(F.lit("programme")).alias("present"), F.lit("Reviewed").alias("programme"))
    return lookup.multi_get(r, t(spark, d, "documents").select("record_id"), "record_id", o).select("record_id", "found", "programme", "status")


@query("jn12_token_lookup", """select p.row_no, o.owner from test_pep p left join
 (select id, min(source) as owner from (select id, source, loaded_at from test_pep where id is not null) where loaded_at + interval 365 day > timestamp '2024-06-01' group by 1) o on p.id = o.id""")  # fmt: skip
def jn12(spark, d):
    p = t(spark, d, "test_pep")
    tokens = p.where("id is not null").select(F.sha2("id", 256).alias("hash"), F.col("source").alias("owner"), (F.col("loaded_at") + F.expr("interval 365 days")).alias("expires_at"))
    return lookup.token_owners(p.select("row_no", F.col("id").alias("token")), tokens, F.to_timestamp(F.lit("2024-06-01"))).select("row_no", "owner")


@query("sim10_name_tokens", f"""select distinct alias_id, gi, t from (select alias_id, i - 1 as gi, unnest(list_filter([words[i], latin[i]], lambda x: x is not null)) as t from (
 select alias_id, {sql_words(sql_norm('whole_name'))} as words, {sql_words(sql_norm('(' + sql_latin('whole_name') + ')'))} as latin from name_alias), unnest(range(1, len(words) + 1)) as r(i))""")  # fmt: skip
def sim10(spark, d):
    n = lookup.name_tokens(t(spark, d, "name_alias").select("alias_id", F.col("pos").alias("ci"), F.col("whole_name").alias("name")), "alias_id")
    return n.select("alias_id", F.col("i").cast("long").alias("gi"), "t")


@query("dml01_import_steps", f"""with recursive k as (select distinct snapshot_no as n from record_snapshot), r as (select record_id as id, source, snapshot_no as n, md5(concat_ws('|', {', '.join(f"coalesce({c}, '')" for c in _CONTENT)})) as h,
 coalesce(status, 'active') as st from record_snapshot qualify row_number() over (partition by record_id, snapshot_no order by line_no desc) = 1),
 p as (select distinct source, n from r), q as (select source, n, lag(n) over (partition by source order by n) as prev from p)
 select q.source, q.n as snapshot_no, count(*) as parsed, count(*) filter (where s.id is null) as added, count(*) filter (where s.id is not null and (s.st = 'delisted' or s.h <> i.h)) as updated
 from q join r i on i.source = q.source and i.n = q.n left join r s on s.source = q.source and s.n = q.prev and s.id = i.id where q.prev is not null group by 1, 2""")  # fmt: skip
def dml01(spark, d):
    """Every delivery of every source against the one before it."""
    s = t(spark, d, "record_snapshot")
    h = F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in _CONTENT]))
    last = s.groupBy(F.col("record_id").alias("id"), "snapshot_no").agg(F.max_by(F.struct("source", "status", h.alias("content_hash"), "line_no"), "line_no").alias("v")).select("id", "snapshot_no", "v.*")
    steps = last.select("source", "snapshot_no").distinct().withColumn("prev", F.lag("snapshot_no").over(Window.partitionBy("source").orderBy("snapshot_no")))
    # a run of one source and number is an id space of its own, so that all steps are classified at once
    run = lambda n: F.concat_ws("/", "source", n.cast("string"), "id")
    incoming = last.join(steps.where("prev is not null"), ["source", "snapshot_no"]).select(run(F.col("snapshot_no")).alias("id"), "content_hash", F.col("line_no").alias("ord"), "source", "snapshot_no")
    following = steps.where("prev is not null").select("source", F.col("prev").alias("snapshot_no"), F.col("snapshot_no").alias("next"))
    stored = last.join(following, ["source", "snapshot_no"]).select(run(F.col("next")).alias("id"), "status", "content_hash")
    change = versions.classify(incoming, stored).join(incoming.select("id", "source", "snapshot_no"), "id")
    return change.groupBy("source", "snapshot_no").agg(F.count("*").alias("parsed"), *[F.count_if(F.col("change") == k).alias(k) for k in ("added", "updated")])


@query("dml02_modes", f"select 'append' as mode, 0::bigint as delisted union all select 'sync', count(*) from ({_GONE})")
def dml02(spark, d):
    i, s = snapshot(spark, d, 5), snapshot(spark, d, 1)
    return versions.diff_counts(i, s, mode="append").select(F.lit("append").alias("mode"), "delisted").unionByName(versions.diff_counts(i, s, mode="sync").select(F.lit("sync").alias("mode"), "delisted"))


@query("dml04_merge_fields", f"""with n as (select record_id as id, type, programme, sanction_reason, listed_at from record_snapshot where snapshot_no = 5 qualify row_number() over (partition by record_id order by line_no desc) = 1)
 select coalesce(n.id, r.id) as id, case when n.id is null then r.type else n.type end as type, case when n.id is null then r.programme else n.programme end as programme, case when n.id is null then r.sanction_reason else n.sanction_reason end as sanction_reason,
 case when r.id is not null then r.listed_at else n.listed_at end as listed_at from n full outer join sanction_record r on n.id = r.id""")  # fmt: skip
def dml04_merge(spark, d):
    fields = ["type", "programme", "sanction_reason", "listed_at"]
    new = t(spark, d, "record_snapshot").where("snapshot_no = 5").groupBy(F.col("record_id").alias("id")).agg(F.max_by(F.struct(*fields), "line_no").alias("v")).select("id", "v.*")
    return imports.merge_fields(new, t(spark, d, "sanction_record").select("id", *fields), "id", ["listed_at"])


@query("dml12_import_lock", """select a.import_id, count(b.import_id) > 0 as blocked from import_log a left join import_log b on a.source = b.source and a.import_id <> b.import_id and b.uploaded_at < a.uploaded_at
 and b.uploaded_at >= a.uploaded_at - interval 900 second and (b.finished_at is null or b.finished_at > a.uploaded_at) group by 1""")  # fmt: skip
def dml12(spark, d):
    return imports.blocked(t(spark, d, "import_log"))


# --- Streams over the events table ------------------------------------------------------------------


@query("st01_tumbling_rate_limit", "select event_id, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) <= 2 as admitted from events")
def st01(spark, d):
    return limits.admitted(t(spark, d, "events"), "user_id", "ts", "event_id", seconds=86400, limit=2).select("event_id", "admitted")


@query("st01_window_counts", "select date_trunc('minute', ts) as window_start, user_id, count(*) as n from events group by 1, 2")
def st01_counts(spark, d):
    return limits.window_counts(t(spark, d, "events"), "user_id", "ts")


@query("st02_cooldown", """with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as i from events),
 r as (select user_id, event_id, ts, i from e where i = 1 union all
 select n.user_id, n.event_id, n.ts, n.i from (select e.user_id, e.event_id, e.ts, e.i, row_number() over (partition by e.user_id order by e.i) as k from r join e on e.user_id = r.user_id and e.i > r.i and e.ts >= r.ts + interval 1 day) n where k = 1)
 select e.event_id, r.event_id is not null as issued from e left join r using (event_id)""")  # fmt: skip
def st02(spark, d):
    return limits.cooled(t(spark, d, "events"), "user_id", "ts", "event_id", seconds=86400).select("event_id", "issued")
