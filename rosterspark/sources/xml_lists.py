"""Government lists published as XML, read with explicit all-string schemas into records.

A reader splits files at record tags, so a list of any size is parsed by all tasks; ids and document
numbers stay text, as leading zeros count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.sources.records import ADDRESS, BIRTH, CONTACT, DOCUMENT, NAME, REGULATION, as_records, filled, first_by, first_to_front, items, joined, none_if_empty, safe_key, shaped, text, unknown_name

EU_SCHEMA = """_logicalId string, _euReferenceNumber string, _unitedNationId string, subjectType struct<_code:string,_classificationCode:string>,
 nameAlias array<struct<_wholeName:string,_firstName:string,_middleName:string,_lastName:string,_strong:string,_nameLanguage:string,_title:string,_function:string>>,
 birthdate array<struct<_birthdate:string,_year:string,_monthOfYear:string,_dayOfMonth:string,_yearRangeFrom:string,_yearRangeTo:string,_circa:string,_city:string,_place:string,_region:string,_countryIso2Code:string,_countryDescription:string>>,
 citizenship array<struct<_countryIso2Code:string,_countryDescription:string>>,
 address array<struct<_street:string,_city:string,_zipCode:string,_poBox:string,_region:string,_place:string,_countryIso2Code:string,_countryDescription:string,contactInfo:array<struct<_key:string,_value:string>>>>,
 identification array<struct<_number:string,_latinNumber:string,_identificationTypeCode:string,_identificationTypeDescription:string,_countryIso2Code:string,_issuedBy:string,_knownFalse:string,_knownExpired:string,_reportedLost:string,_revokedByIssuer:string,_diplomatic:string>>,
 regulation array<struct<_numberTitle:string,_programme:string,_publicationDate:string,_entryIntoForceDate:string,publicationUrl:string>>,
 regulationSummary array<struct<_numberTitle:string,_programme:string,_publicationDate:string,_entryIntoForceDate:string,_publicationUrl:string>>"""

_UN_ADDRESS = "array<struct<STREET:string,CITY:string,STATE_PROVINCE:string,COUNTRY:string>>"
UN_INDIVIDUAL = f"""DATAID string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, COMMENTS1 string, NATIONALITY struct<VALUE:array<string>>,
 INDIVIDUAL_ALIAS array<struct<QUALITY:string,ALIAS_NAME:string>>, INDIVIDUAL_ADDRESS {_UN_ADDRESS}, INDIVIDUAL_DATE_OF_BIRTH array<struct<DATE:string,YEAR:string>>,
 INDIVIDUAL_PLACE_OF_BIRTH array<struct<CITY:string,STATE_PROVINCE:string,COUNTRY:string>>,
 INDIVIDUAL_DOCUMENT array<struct<TYPE_OF_DOCUMENT:string,NUMBER:string,ISSUING_COUNTRY:string,COUNTRY_OF_ISSUE:string>>"""
UN_ENTITY = f"DATAID string, FIRST_NAME string, COMMENTS1 string, REASON_FOR_LISTING string, ENTITY_ALIAS array<struct<ALIAS_NAME:string>>, ENTITY_ADDRESS {_UN_ADDRESS}"

US_SCHEMA = """uid string, firstName string, lastName string, sdnType string, programList struct<program:array<string>>,
 akaList struct<aka:array<struct<category:string,firstName:string,lastName:string>>>,
 addressList struct<address:array<struct<address1:string,address2:string,address3:string,city:string,stateOrProvince:string,postalCode:string,country:string>>>,
 dateOfBirthList struct<dateOfBirthItem:array<struct<dateOfBirth:string>>>, placeOfBirthList struct<placeOfBirthItem:array<struct<placeOfBirth:string>>>,
 idList struct<id:array<struct<idType:string,idNumber:string,idCountry:string,expirationDate:string>>>,
 nationalityList struct<nationality:array<struct<country:string>>>, citizenshipList struct<citizenship:array<struct<country:string>>>"""

UK_SCHEMA = """UniqueID string, UNReferenceNumber string, RegimeName string, IndividualEntityShip string, OtherInformation string,
 Names struct<Name:array<struct<Name1:string,Name2:string,Name3:string,Name4:string,Name5:string,Name6:string,NameType:string>>>,
 NonLatinNames struct<NonLatinName:array<struct<NameNonLatinScript:string>>>,
 Addresses struct<Address:array<struct<AddressLine1:string,AddressLine2:string,AddressLine3:string,AddressLine4:string,AddressLine5:string,AddressLine6:string,AddressPostalCode:string,AddressCountry:string>>>,
 IndividualDetails struct<Individual:struct<DOBs:struct<DOB:array<string>>,Nationalities:struct<Nationality:array<string>>,BirthDetails:struct<Location:array<struct<TownOfBirth:string,CountryOfBirth:string>>>,PassportDetails:struct<Passport:array<struct<PassportNumber:string>>>,NationalIdentifierDetails:struct<NationalIdentifier:array<struct<NationalIdentifierNumber:string>>>>>,
 ShipDetails struct<Ship:struct<IMONumbers:struct<IMONumber:array<string>>>>"""

_CH_NAME_PART = "struct<_order:string,value:string,`spelling-variant`:array<struct<_lang:string,_script:string,_VALUE:string>>>"
_CH_BODY = f"""struct<`_object-type`:string,identity:array<struct<name:array<struct<`_name-type`:string,_quality:string,_lang:string,`name-part`:array<{_CH_NAME_PART}>>>,
 `day-month-year`:array<struct<_day:string,_month:string,_year:string,_circa:string>>,
 `identification-document`:array<struct<`_document-type`:string,_number:string,number:string,issuer:string,country:string>>,
 address:array<struct<`address-details`:string,street:string,`p-o-box`:string,`zip-code`:string,city:string,country:string>>>>,
 justification:array<string>,`other-information`:array<string>>""".replace("\n", "")
CH_SCHEMA = f"_ssid string, individual {_CH_BODY}, entity {_CH_BODY}, object {_CH_BODY}, modification array<struct<`_modification-type`:string,`_effective-date`:string,`_publication-date`:string,`_enactment-date`:string>>"

# Document types of the US list that are identifications.
US_ID_TYPES = [
    "Passport", "Diplomatic Passport", "British National Overseas Passport", "Stateless Person Passport", "Travel Document Number", "Refugee ID Card", "Stateless Person ID Card",
    "Seafarer's Identification Document", "Immigration No.", "Public Security and Immigration No.", "VisaNumberID",
    "National ID No.", "National Foreign ID Number", "Identification Number", "Personal ID Card", "Citizen's Card Number", "Numero de Identidad", "Tarjeta de Identidad", "Credencial electoral",
    "Electoral Registry No.", "I.F.E.", "D.N.I.", "C.U.I.", "C.U.I.P.", "C.U.R.P.", "CNP (Personal Numerical Code)", "Tazkira National ID Card", "Turkish Identification Number", "Kenyan ID No.",
    "Moroccan Personal ID No.", "Bosnian Personal ID No.", "UAE Identification", "Birth Certificate Number", "Cartilla de Servicio Militar Nacional", "Military Registration Number",
    "Romanian Permanent Resident", "Residency Number", "Federal ID Card", "N.I.E.", "SSN",
    "Tax ID No.", "Registration Number", "Business Registration Number", "Business Registration Document #", "Registration ID", "Company Number", "UK Company Number", "Enterprise Number", "Entity Code",
    "Legal Entity Number", "LE Number", "Central Registration System Number", "Commercial Registry Number", "Romanian C.R.", "C.R. No.", "Public Registration Number", "Certificate of Incorporation Number",
    "Registration Certificate Number (Dubai)", "Chamber of Commerce Number", "Istanbul Chamber of Comm. No.", "Dubai Chamber of Commerce Membership No.", "Folio Mercantil No.", "Matricula Mercantil No",
    "Business Number", "Branch Unit Number", "Organization Code", "United Social Credit Code Certificate (USCCC)", "Unified Social Credit Code (USCC)", "Chinese Commercial Code",
    "Economic Register Number (CBLS)", "Registered Charity No.", "C.I.N.", "US FEIN", "D-U-N-S Number", "Cedula No.", "R.F.C.", "RFC", "RUC #", "NIT #", "RIF #", "RTN", "C.I.F.", "C.U.I.T.", "N.I.F.",
    "Numero Unico de Identificacao Tributaria (NUIT)", "Italian Fiscal Code", "Paraguayan tax identification number", "Romanian Tax Registration", "Fiscal Code", "V.A.T. Number",
    "Russian State Individual Business Registration Number Pattern (OGRNIP)", "Global Intermediary Identification Number", "Government Gazette Number", "File Number", "Serial No.", "Trade License No.",
    "License", "Permit Number", "SRE Permit No.", "Tourism License No.", "Driver's License No.", "Pilot License Number", "MSB Registration Number", "Afghan Money Service Provider License Number", "Trademark number",
    "SWIFT/BIC", "BIK (RU)", "ISIN", "MICEX Code", "Equity Ticker",
    "Vessel Registration Identification", "MMSI", "Other Vessel Call Sign", "Aircraft Tail Number", "Previous Aircraft Tail Number", "Aircraft Manufacturer's Serial Number (MSN)",
    "Aircraft Construction Number (also called L/N or S/N or F/N)", "Aircraft Serial Identification", "Aircraft Mode S Transponder Code",
    *[f"Digital Currency Address - {x}" for x in "XBT TRX ETH USDT LTC XMR BCH DASH ZEC SOL USDC DOGE BTG ETC BSV XVG XRP ARB BSC BNB".split()],
]


def read_tag(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One row per ``tag`` element; attributes as ``_name``; a malformed file fails the read."""
    return spark.read.format("xml").schema(schema).options(rowTag=tag, ignoreNamespace="true", attributePrefix="_", valueTag="_VALUE", mode="FAILFAST", inferSchema="false").load(path)


def _told(c: Column) -> Column:
    """Trimmed, null for blanks and the marks lists use for nothing."""
    t = text(c)
    return F.when(~F.lower(t).isin("", "-", "--", "unknown"), t)


def _told_country(c: Column) -> Column:
    return F.when(text(c) != "00", _told(c))


def _flag(c: Column) -> Column:
    return F.lower(text(c)).isin("true", "1")


def _whole(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text(c), r"^([+-]?\d+)", 1), F.lit("")).cast("int")


def _birth_texts(c: Column) -> Column:
    return none_if_empty(F.transform(c, lambda x: shaped(BIRTH, raw=x)))


def read_eu(spark: SparkSession, path: str) -> DataFrame:
    """The EU list: everything in attributes; the primary alias is a strong one with name parts in no or English language, as far as there is such."""
    e = read_tag(spark, path, "sanctionEntity", EU_SCHEMA)
    key = text(F.col("_logicalId"))

    def one(a: Column) -> Column:
        parts = joined(a["_firstName"], a["_middleName"], a["_lastName"], sep=" ")
        whole = F.coalesce(filled(a["_wholeName"]), parts)
        name = shaped(NAME, whole_name=whole, first_name=filled(a["_firstName"]), middle_name=filled(a["_middleName"]), last_name=filled(a["_lastName"]), strong=_flag(a["_strong"]), language=filled(a["_nameLanguage"]), title=filled(a["_title"]), func=filled(a["_function"]))
        return F.struct(whole.alias("whole_name"), name.alias("name"), _flag(a["_strong"]).alias("strong"), (filled(a["_firstName"]).isNotNull() & filled(a["_lastName"]).isNotNull()).alias("parts"), F.lower(text(a["_nameLanguage"])).isin("", "en").alias("lang"))

    kind = f"struct<whole_name:string,name:{NAME},strong:boolean,parts:boolean,lang:boolean>"
    found = first_by(F.filter(F.transform(items(F.col("nameAlias"), e.schema["nameAlias"].dataType.simpleString()), one), lambda x: x["whole_name"].isNotNull()), "whole_name", kind)
    # narrowing by each criterion unless it leaves nothing is the order of the criteria, then of the document
    ranked = F.array_max(F.transform(found, lambda x, i: F.struct(x["strong"].alias("s"), x["parts"].alias("p"), x["lang"].alias("l"), (-i).alias("i"))))
    names = F.when(F.size(found) > 0, F.transform(first_to_front(found, -ranked["i"]), lambda x: x["name"])).otherwise(F.array(unknown_name()))

    def address(a: Column) -> Column:
        code = _told_country(a["_countryIso2Code"])
        country = F.coalesce(_told_country(a["_countryDescription"]), code)
        full = joined(_told(a["_street"]), _told(a["_poBox"]), _told(a["_place"]), _told(a["_city"]), _told(a["_region"]), _told(a["_zipCode"]), country)
        return shaped(ADDRESS, street=_told(a["_street"]), city=_told(a["_city"]), country=country, full_address=full, po_box=_told(a["_poBox"]), region=_told(a["_region"]), place=_told(a["_place"]), country_iso2=code)

    def birth(b: Column) -> Column:
        return shaped(BIRTH, raw=_told(b["_birthdate"]), birth_year=_whole(b["_year"]), birth_month=_whole(b["_monthOfYear"]), birth_day=_whole(b["_dayOfMonth"]), year_range_from=_whole(b["_yearRangeFrom"]), year_range_to=_whole(b["_yearRangeTo"]), circa=_flag(b["_circa"]), city=_told(b["_city"]), place=_told(b["_place"]), country_iso2=_told_country(b["_countryIso2Code"]))

    def document(d: Column) -> Column:
        return shaped(DOCUMENT, number=F.coalesce(_told(d["_number"]), _told(d["_latinNumber"])), type_code=_told(d["_identificationTypeCode"]), type_description=_told(d["_identificationTypeDescription"]), country_iso2=_told_country(d["_countryIso2Code"]), issued_by=_told(d["_issuedBy"]), known_false=_flag(d["_knownFalse"]), known_expired=_flag(d["_knownExpired"]), reported_lost=_flag(d["_reportedLost"]), revoked_by_issuer=_flag(d["_revokedByIssuer"]), diplomatic=_flag(d["_diplomatic"]))

    each = {c: items(F.col(c), e.schema[c].dataType.simpleString()) for c in ("birthdate", "citizenship", "address", "identification")}
    place = lambda b: joined(_told(b["_city"]), _told(b["_place"]), _told(b["_region"]), F.coalesce(_told_country(b["_countryDescription"]), _told_country(b["_countryIso2Code"])))
    act, summary = F.get("regulation", F.lit(0)), F.get("regulationSummary", F.lit(0))
    pick = lambda f: F.coalesce(_told(act[f]), F.when(act.isNull(), _told(summary[f])))
    url = F.coalesce(_told(act["publicationUrl"]), F.when(act.isNull(), _told(summary["_publicationUrl"])))
    regulation = shaped(REGULATION, number_title=pick("_numberTitle"), programme=pick("_programme"), publication_date=pick("_publicationDate"), entry_into_force_date=pick("_entryIntoForceDate"), url=url)
    contacts = F.flatten(F.transform(each["address"], lambda a: items(a["contactInfo"], "array<struct<_key:string,_value:string>>")))
    of = lambda k: none_if_empty(F.array_distinct(F.array_compact(F.transform(F.filter(contacts, lambda c: F.upper(text(c["_key"])) == k), lambda c: _told(c["_value"])))))
    contact = shaped(CONTACT, phone_numbers=of("PHONE"), fax_numbers=of("FAX"), emails=of("EMAIL"), websites=of("WEB"))
    person = (F.lower(text(F.col("subjectType._code"))) == "person") | ((text(F.col("subjectType._code")) == "") & (F.upper(text(F.col("subjectType._classificationCode"))) == "P"))
    out = e.where(safe_key(key)).select(
        F.concat(F.lit("EU-"), key).alias("id"), F.lit("EU").alias("source"), F.when(person, "individual").otherwise("entity").alias("type"), names.alias("names"),
        none_if_empty(F.filter(F.transform(each["birthdate"], birth), lambda b: F.coalesce(b["raw"], b["birth_year"].cast("string"), b["year_range_from"].cast("string"), b["city"], b["place"]).isNotNull())).alias("birth_dates"),
        none_if_empty(F.array_distinct(F.array_compact(F.transform(each["birthdate"], place)))).alias("places_of_birth"),
        none_if_empty(F.array_distinct(F.array_compact(F.transform(each["citizenship"], lambda c: F.coalesce(_told_country(c["_countryDescription"]), _told_country(c["_countryIso2Code"])))))).alias("citizenships"),
        none_if_empty(F.filter(F.transform(each["identification"], document), lambda d: d["number"].isNotNull())).alias("identifications"),
        none_if_empty(F.filter(F.transform(each["address"], address), lambda a: a["full_address"].isNotNull())).alias("addresses"),
        regulation["number_title"].alias("sanction_reason"), url.alias("legal_basis"), _told(F.col("_unitedNationId")).alias("united_nation_id"), _told(F.col("_euReferenceNumber")).alias("eu_reference_number"), key.alias("source_ref"),
        F.when(F.coalesce(*[regulation[f] for f in ("number_title", "programme", "publication_date", "entry_into_force_date", "url")]).isNotNull(), regulation).alias("regulation"),
        F.when(F.coalesce(of("PHONE"), of("FAX"), of("EMAIL"), of("WEB")).isNotNull(), contact).alias("contact_info"),
    )
    return as_records(out)


def named(primary: Column, aliases: Column, strong: Column) -> Column:
    """Names from a primary one and ``array<struct<name, strong>>``: blanks and repeats dropped; the primary is strong unless the list says otherwise."""
    first = F.array(shaped(NAME, whole_name=primary, strong=F.lit(True)))
    others = F.transform(F.filter(aliases, lambda a: F.coalesce(a["name"], F.lit("")) != ""), lambda a: shaped(NAME, whole_name=a["name"], strong=F.when(strong, a["strong"]).otherwise(F.lit(False))))
    return first_by(F.concat(first, others), "whole_name", NAME)


def read_un(spark: SparkSession, path: str) -> DataFrame:
    """The UN list: individuals and entities; an alias of good quality is strong for individuals only."""

    def address(a: Column) -> Column:
        return shaped(ADDRESS, street=filled(a["STREET"]), city=filled(a["CITY"]), country=filled(a["COUNTRY"]), full_address=joined(a["STREET"], a["CITY"], a["STATE_PROVINCE"], a["COUNTRY"]))

    p = read_tag(spark, path, "INDIVIDUAL", UN_INDIVIDUAL).where(text(F.col("DATAID")) != "")
    each = {c: items(F.col(c), p.schema[c].dataType.simpleString()) for c in ("INDIVIDUAL_ALIAS", "INDIVIDUAL_ADDRESS", "INDIVIDUAL_DATE_OF_BIRTH", "INDIVIDUAL_PLACE_OF_BIRTH", "INDIVIDUAL_DOCUMENT")}
    aliases = F.transform(each["INDIVIDUAL_ALIAS"], lambda a: F.struct(text(a["ALIAS_NAME"]).alias("name"), (F.lower(text(a["QUALITY"])) == "good").alias("strong")))
    document = lambda d: shaped(DOCUMENT, number=filled(d["NUMBER"]), type_description=filled(d["TYPE_OF_DOCUMENT"]), country_iso2=F.coalesce(filled(d["ISSUING_COUNTRY"]), filled(d["COUNTRY_OF_ISSUE"])))
    people = as_records(p.select(
        F.concat(F.lit("UN-"), text(F.col("DATAID"))).alias("id"), F.lit("UN").alias("source"), F.lit("individual").alias("type"),
        named(F.coalesce(joined(*[F.col(c) for c in ("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME")], sep=" "), F.lit("Unknown Name")), aliases, F.lit(True)).alias("names"),
        _birth_texts(F.array_compact(F.transform(each["INDIVIDUAL_DATE_OF_BIRTH"], lambda d: F.coalesce(filled(d["DATE"]), filled(d["YEAR"]))))).alias("birth_dates"),
        none_if_empty(F.array_compact(F.transform(each["INDIVIDUAL_PLACE_OF_BIRTH"], lambda b: joined(b["CITY"], b["STATE_PROVINCE"], b["COUNTRY"])))).alias("places_of_birth"),
        none_if_empty(F.array_distinct(F.array_compact(F.transform(items(F.col("NATIONALITY.VALUE"), "array<string>"), filled)))).alias("citizenships"),
        none_if_empty(F.filter(F.transform(each["INDIVIDUAL_DOCUMENT"], document), lambda d: d["number"].isNotNull())).alias("identifications"),
        none_if_empty(F.transform(each["INDIVIDUAL_ADDRESS"], address)).alias("addresses"), filled(F.col("COMMENTS1")).alias("sanction_reason"),
    ))
    e = read_tag(spark, path, "ENTITY", UN_ENTITY).where(text(F.col("DATAID")) != "")
    others = F.transform(items(F.col("ENTITY_ALIAS"), "array<struct<ALIAS_NAME:string>>"), lambda a: F.struct(text(a["ALIAS_NAME"]).alias("name"), F.lit(False).alias("strong")))
    bodies = as_records(e.select(
        F.concat(F.lit("UN-"), text(F.col("DATAID"))).alias("id"), F.lit("UN").alias("source"), F.lit("entity").alias("type"),
        named(F.coalesce(filled(F.col("FIRST_NAME")), F.lit("Unknown Name")), others, F.lit(False)).alias("names"),
        none_if_empty(F.transform(items(F.col("ENTITY_ADDRESS"), _UN_ADDRESS), address)).alias("addresses"), F.coalesce(filled(F.col("COMMENTS1")), filled(F.col("REASON_FOR_LISTING"))).alias("sanction_reason"),
    ))
    return people.unionByName(bodies)


def expired(c: Column, as_of: Column) -> Column:
    """Whether a US expiry (``d Mon yyyy``, ``Mon yyyy``, ``yyyy`` or the end of ``A to B``) lies before ``as_of``; false if it cannot be read."""
    last = F.trim(F.regexp_replace(text(c), r"(?i)^.*\s+to\s+", ""))
    months = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
    dmy, my, y = r"^(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})$", r"^([A-Za-z]{3})\s+(\d{4})$", r"^(\d{4})$"

    def day(year: Column, month: Column, d: Column) -> Column:
        return F.to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), d.cast("int")))

    number = lambda p, i: F.nullif(F.array_position(months, F.regexp_extract(last, p, i)), F.lit(0))
    end = (
        F.when(last.rlike(dmy), F.when(number(dmy, 2).isNotNull(), F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(last, dmy, 3), F.lpad(number(dmy, 2).cast("string"), 2, "0"), F.lpad(F.regexp_extract(last, dmy, 1), 2, "0"))).cast("date")))
        .when(last.rlike(my), F.when(number(my, 1).isNotNull(), F.last_day(F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(last, my, 2), F.lpad(number(my, 1).cast("string"), 2, "0"), F.lit("01"))).cast("date"))))
        .when(last.rlike(y), F.try_to_timestamp(F.concat(last, F.lit("-12-31"))).cast("date"))
    )
    return F.coalesce(end < as_of, F.lit(False))


def read_us(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """The US list; a document counts as expired by the date ``as_of``."""
    e = read_tag(spark, path, "sdnEntry", US_SCHEMA)
    key = text(F.col("uid"))
    get = lambda c, kind: items(F.col(c), kind)
    full = lambda x: joined(x["firstName"], x["lastName"], sep=" ")
    aliases = F.transform(get("akaList.aka", "array<struct<category:string,firstName:string,lastName:string>>"), lambda a: F.struct(full(a).alias("name"), (F.lower(text(a["category"])) == "strong").alias("strong")))

    def address(a: Column) -> Column:
        street = joined(a["address1"], a["address2"], a["address3"])
        return shaped(ADDRESS, street=street, city=filled(a["city"]), country=filled(a["country"]), full_address=joined(street, a["city"], a["stateOrProvince"], a["postalCode"], a["country"]))

    allowed = F.array(*[F.lit(t) for t in US_ID_TYPES])
    ids = F.filter(get("idList.id", "array<struct<idType:string,idNumber:string,idCountry:string,expirationDate:string>>"), lambda d: (text(d["idNumber"]) != "") & F.array_contains(allowed, text(d["idType"])))
    lands = F.concat(F.transform(get("nationalityList.nationality", "array<struct<country:string>>"), lambda n: filled(n["country"])), F.transform(get("citizenshipList.citizenship", "array<struct<country:string>>"), lambda n: filled(n["country"])))
    kind = F.lower(text(F.col("sdnType")))
    return as_records(e.where(safe_key(key)).select(
        F.concat(F.lit("US-SDN-"), key).alias("id"), F.lit("US").alias("source"), F.when(kind.isin("individual", "vessel", "aircraft"), kind).otherwise("entity").alias("type"),
        named(F.coalesce(joined(F.col("firstName"), F.col("lastName"), sep=" "), F.lit("Unknown Name")), aliases, F.lit(True)).alias("names"),
        _birth_texts(F.array_compact(F.transform(get("dateOfBirthList.dateOfBirthItem", "array<struct<dateOfBirth:string>>"), lambda d: filled(d["dateOfBirth"])))).alias("birth_dates"),
        none_if_empty(F.array_compact(F.transform(get("placeOfBirthList.placeOfBirthItem", "array<struct<placeOfBirth:string>>"), lambda d: filled(d["placeOfBirth"])))).alias("places_of_birth"),
        none_if_empty(F.array_distinct(F.array_compact(lands))).alias("citizenships"),
        none_if_empty(F.transform(ids, lambda d: shaped(DOCUMENT, number=text(d["idNumber"]), type_description=text(d["idType"]), country_iso2=filled(d["idCountry"]), known_expired=expired(d["expirationDate"], F.lit(as_of).cast("date"))))).alias("identifications"),
        none_if_empty(F.transform(get("addressList.address", "array<struct<address1:string,address2:string,address3:string,city:string,stateOrProvince:string,postalCode:string,country:string>>"), address)).alias("addresses"),
        F.nullif(F.array_join(get("programList.program", "array<string>"), ", "), F.lit("")).alias("sanction_reason"),
    ))


def uk_birth(c: Column) -> Column:
    """A UK date of birth: day first; ``dd/MM/yyyy`` and ``dd/mm/yyyy`` with letters mean unknown parts; null if of another shape."""
    t = text(c)
    full, month, year = r"^(\d{2})/(\d{2})/(\d{4})$", r"(?i)^dd/(\d{2})/(\d{4})$", r"(?i)^(?:dd/mm/)?(\d{4})$"
    x = lambda p, i: F.regexp_extract(t, p, i)
    return (
        F.when(t.rlike(full), shaped(BIRTH, raw=F.concat_ws("-", x(full, 3), x(full, 2), x(full, 1)), birth_year=x(full, 3).cast("int"), birth_month=x(full, 2).cast("int"), birth_day=x(full, 1).cast("int")))
        .when(t.rlike(month), shaped(BIRTH, birth_year=x(month, 2).cast("int"), birth_month=x(month, 1).cast("int")))
        .when(t.rlike(year), shaped(BIRTH, birth_year=x(year, 1).cast("int")))
    )


def read_uk(spark: SparkSession, path: str) -> DataFrame:
    """The UK list: latin and other scripts' names; the first of type primary name leads."""
    e = read_tag(spark, path, "Designation", UK_SCHEMA)
    key, one = text(F.col("UniqueID")), "IndividualDetails.Individual"
    latin = F.transform(items(F.col("Names.Name"), "array<struct<Name1:string,Name2:string,Name3:string,Name4:string,Name5:string,Name6:string,NameType:string>>"), lambda n: shaped(NAME, whole_name=joined(*[n[f"Name{i}"] for i in range(1, 7)], sep=" "), strong=F.lower(text(n["NameType"])) == "primary name"))
    other = F.transform(items(F.col("NonLatinNames.NonLatinName"), "array<struct<NameNonLatinScript:string>>"), lambda n: shaped(NAME, whole_name=filled(n["NameNonLatinScript"]), strong=F.lit(False)))
    found = first_by(F.filter(F.concat(latin, other), lambda n: n["whole_name"].isNotNull()), "whole_name", NAME)
    chosen = F.greatest(F.array_position(F.transform(found, lambda n: n["strong"]), True).cast("int") - 1, F.lit(0))
    names = F.when(F.size(found) > 0, first_to_front(found, chosen)).otherwise(F.array(unknown_name()))
    births = first_by(F.filter(F.transform(items(F.col(f"{one}.DOBs.DOB"), "array<string>"), lambda d: F.struct(uk_birth(d).alias("b"), F.coalesce(uk_birth(d)["raw"], F.concat_ws("-", uk_birth(d)["birth_year"].cast("string"), uk_birth(d)["birth_month"].cast("string"))).alias("k"))), lambda d: d["b"].isNotNull()), "k", f"struct<b:{BIRTH},k:string>")

    def numbers(c: str, field: str | None, label: str) -> Column:
        kind = f"array<struct<{field}:string>>" if field else "array<string>"
        got = F.array_compact(F.transform(items(F.col(c), kind), lambda n: filled(n[field] if field else n)))
        return F.transform(got, lambda n: shaped(DOCUMENT, number=n, type_description=F.lit(label)))

    def address(a: Column) -> Column:
        street = joined(*[a[f"AddressLine{i}"] for i in range(1, 7)])
        return shaped(ADDRESS, street=street, country=filled(a["AddressCountry"]), full_address=joined(street, a["AddressPostalCode"], a["AddressCountry"]))

    kind = F.lower(text(F.col("IndividualEntityShip")))
    docs = F.concat(numbers(f"{one}.PassportDetails.Passport", "PassportNumber", "Passport"), numbers(f"{one}.NationalIdentifierDetails.NationalIdentifier", "NationalIdentifierNumber", "National Identifier"), numbers("ShipDetails.Ship.IMONumbers.IMONumber", None, "IMO Number"))
    lines = items(F.col("Addresses.Address"), "array<struct<AddressLine1:string,AddressLine2:string,AddressLine3:string,AddressLine4:string,AddressLine5:string,AddressLine6:string,AddressPostalCode:string,AddressCountry:string>>")
    return as_records(e.where(safe_key(key)).select(
        F.concat(F.lit("UK-"), key).alias("id"), F.lit("UK").alias("source"), F.when(kind == "individual", "individual").when(kind == "ship", "vessel").otherwise("entity").alias("type"), names.alias("names"),
        none_if_empty(F.transform(births, lambda b: b["b"])).alias("birth_dates"),
        none_if_empty(F.array_distinct(F.array_compact(F.transform(items(F.col(f"{one}.BirthDetails.Location"), "array<struct<TownOfBirth:string,CountryOfBirth:string>>"), lambda p: joined(p["TownOfBirth"], p["CountryOfBirth"]))))).alias("places_of_birth"),
        none_if_empty(F.array_distinct(F.array_compact(F.transform(items(F.col(f"{one}.Nationalities.Nationality"), "array<string>"), filled)))).alias("citizenships"),
        none_if_empty(docs).alias("identifications"), none_if_empty(F.filter(F.transform(lines, address), lambda a: a["full_address"].isNotNull())).alias("addresses"),
        filled(F.col("OtherInformation")).alias("sanction_reason"), filled(F.col("RegimeName")).alias("legal_basis"), filled(F.col("UNReferenceNumber")).alias("united_nation_id"), key.alias("source_ref"),
    ))


def read_ch(spark: SparkSession, path: str) -> DataFrame:
    """The Swiss list: name parts by their order, spelling variants of one language and script as one alias; a target once de-listed stays so."""
    e = read_tag(spark, path, "target", CH_SCHEMA)
    key = text(F.col("_ssid"))
    body = F.coalesce("individual", "entity", "object")
    kind = F.lower(text(F.col("object._object-type")))
    base = e.where(safe_key(key) & body.isNotNull()).select(key.alias("key"), F.when(F.col("individual").isNotNull(), "individual").when(F.col("entity").isNotNull(), "entity").when(kind.isin("vessel", "aircraft"), kind).otherwise("entity").alias("type"), body.alias("b"), F.col("modification").alias("m"))
    body_type = base.schema["b"].dataType
    inner = {f.name: f.dataType for f in body_type["identity"].dataType.elementType.fields}

    def of(c: str) -> Column:
        return F.flatten(F.transform(F.coalesce(F.col("b.identity"), F.array().cast(body_type["identity"].dataType)), lambda i: items(i[c], inner[c])))

    def all_of_name(n: Column) -> Column:
        strong, lang = F.lower(text(n["_quality"])) != "low", filled(n["_lang"])
        parts = F.array_sort(F.transform(items(n["name-part"], f"array<{_CH_NAME_PART}>"), lambda p, i: F.struct(F.coalesce(p["_order"].cast("double"), F.lit(1.0)).alias("o"), i.alias("i"), text(p["value"]).alias("v"), items(p["spelling-variant"], "array<struct<_lang:string,_script:string,_VALUE:string>>").alias("s"))))
        whole = joined(*[F.array_join(F.filter(F.transform(parts, lambda p: p["v"]), lambda v: v != ""), " ")])
        variants = F.filter(F.flatten(F.transform(parts, lambda p: F.transform(p["s"], lambda s: F.struct(F.concat_ws("_", F.coalesce(filled(s["_lang"]), F.lit("unk")), F.coalesce(filled(s["_script"]), F.lit("unk"))).alias("k"), text(s["_VALUE"]).alias("v"))))), lambda s: s["v"] != "")
        groups = F.transform(F.array_distinct(F.transform(variants, lambda s: s["k"])), lambda k: F.array_join(F.transform(F.filter(variants, lambda s: s["k"] == k), lambda s: s["v"]), " "))
        return F.transform(F.concat(F.array(whole), groups), lambda w, i: F.struct(shaped(NAME, whole_name=w, strong=strong, language=lang).alias("n"), w.alias("w"), ((i == 0) & (F.lower(text(n["_name-type"])) == "primary-name")).alias("p")))

    found = first_by(F.filter(F.flatten(F.transform(of("name"), all_of_name)), lambda x: x["w"].isNotNull()), "w", f"struct<n:{NAME},w:string,p:boolean>")
    births = F.transform(of("day-month-year"), lambda d: shaped(BIRTH, birth_year=_whole(d["_year"]), birth_month=_whole(d["_month"]), birth_day=_whole(d["_day"]), circa=F.when(text(d["_circa"]) == "true", True), raw=F.when(F.least(_whole(d["_day"]), _whole(d["_month"])).isNotNull() & _whole(d["_day"]).isNotNull() & _whole(d["_month"]).isNotNull(), F.concat_ws("-", _whole(d["_year"]).cast("string"), F.lpad(_whole(d["_month"]).cast("string"), 2, "0"), F.lpad(_whole(d["_day"]).cast("string"), 2, "0"))).otherwise(_whole(d["_year"]).cast("string"))))
    docs = F.transform(of("identification-document"), lambda d: shaped(DOCUMENT, number=F.coalesce(filled(d["number"]), filled(d["_number"])), type_description=filled(d["_document-type"]), issued_by=filled(d["issuer"]), country_iso2=filled(d["country"])))
    places = F.transform(of("address"), lambda a: shaped(ADDRESS, street=filled(a["street"]), city=filled(a["city"]), po_box=filled(a["p-o-box"]), region=filled(a["zip-code"]), country=filled(a["country"]), full_address=joined(a["address-details"], a["street"], a["p-o-box"], a["zip-code"], a["city"], a["country"])))
    mods = items(F.col("m"), base.schema["m"].dataType)
    when = lambda m: F.coalesce(filled(m["_effective-date"]), filled(m["_publication-date"]), filled(m["_enactment-date"]))
    of_type = lambda t: F.filter(mods, lambda m: F.lower(text(m["_modification-type"])) == t)
    dates = lambda t: F.array_compact(F.transform(of_type(t), when))
    said = lambda c: F.nullif(F.array_join(F.filter(F.transform(items(F.col(c), "array<string>"), text), lambda x: x != ""), "; "), F.lit(""))
    return as_records(base.select(
        F.concat(F.lit("CH-"), "key").alias("id"), F.lit("CH").alias("source"), "type",
        F.when(F.size(found) > 0, F.transform(found, lambda x: x["n"])).otherwise(F.array(shaped(NAME, whole_name=F.concat(F.lit("Target "), F.col("key")), strong=F.lit(False)))).alias("names"),
        none_if_empty(F.filter(births, lambda b: b["birth_year"].isNotNull())).alias("birth_dates"), none_if_empty(F.filter(docs, lambda d: d["number"].isNotNull())).alias("identifications"),
        none_if_empty(F.filter(places, lambda a: a["full_address"].isNotNull())).alias("addresses"), F.coalesce(said("b.justification"), said("b.other-information")).alias("sanction_reason"),
        F.when(F.size(of_type("de-listed")) > 0, "delisted").otherwise("active").alias("status"), F.try_element_at(dates("listed"), F.lit(-1)).alias("listed_at"), F.when(F.size(of_type("de-listed")) > 0, when(F.try_element_at(of_type("de-listed"), F.lit(-1)))).alias("delisted_at"),
    ))
