"""List sources on small files of their own: fields, skipped entries, formats, paths."""

import json

import pytest

from rosterspark.sources.other_lists import confined_path, formats, query_lines, read_csv_list, read_ua
from rosterspark.sources.xml_lists import read_ch, read_eu, read_uk, read_un, read_us

EU = """<?xml version="1.0"?><export xmlns="http://eu.europa.ec/fpi/fsd/export" generationDate="2024-01-02T00:00:00" globalFileId="1">
<sanctionEntity logicalId="13" euReferenceNumber="EU.1.2" unitedNationId="-"><subjectType code="person" classificationCode="P"/>
<nameAlias wholeName="Наме" firstName="" lastName="" strong="true" nameLanguage="RU"/><nameAlias wholeName="Weak One" firstName="Weak" lastName="One" strong="false" nameLanguage="EN"/>
<nameAlias wholeName="Ann Berg" firstName="Ann" lastName="Berg" strong="true" nameLanguage="EN" title="Ms" function="Chair"/><nameAlias wholeName="Ann Berg" firstName="" lastName="" strong="true" nameLanguage=""/>
<birthdate birthdate="1960-02-03" year="1960" monthOfYear="2" dayOfMonth="3" circa="false" city="Oslo" countryIso2Code="00" countryDescription="UNKNOWN"/><birthdate yearRangeFrom="1958" yearRangeTo="1962" circa="true"/>
<citizenship countryIso2Code="SE" countryDescription="SWEDEN"/><citizenship countryIso2Code="00" countryDescription="UNKNOWN"/>
<address street="Road 1" city="Oslo" zipCode="0150" countryIso2Code="NO" countryDescription="NORWAY"><contactInfo key="EMAIL" value="a@b.no"/><contactInfo key="EMAIL" value="a@b.no"/></address><address street="" city="-"/>
<identification number="-" latinNumber="0035" identificationTypeCode="passport" countryIso2Code="NO" knownFalse="true"/>
<regulation numberTitle="2020/1" programme="X" publicationDate="2020-01-01"><publicationUrl>http://x</publicationUrl></regulation></sanctionEntity>
<sanctionEntity logicalId="a b"><subjectType code="enterprise"/></sanctionEntity><sanctionEntity logicalId="14"><subjectType code="enterprise"/></sanctionEntity></export>"""
UN = """<?xml version="1.0"?><CONSOLIDATED_LIST dateGenerated="2024-01-03"><INDIVIDUALS><INDIVIDUAL><DATAID>0075</DATAID><FIRST_NAME>Ann</FIRST_NAME><THIRD_NAME>Berg</THIRD_NAME><COMMENTS1> why </COMMENTS1>
<NATIONALITY><VALUE>Norway</VALUE><VALUE>Norway</VALUE></NATIONALITY><INDIVIDUAL_ALIAS><QUALITY>Good</QUALITY><ALIAS_NAME>A Berg</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_ALIAS><QUALITY>Low</QUALITY><ALIAS_NAME>Anna</ALIAS_NAME></INDIVIDUAL_ALIAS>
<INDIVIDUAL_DATE_OF_BIRTH><TYPE_OF_DATE>EXACT</TYPE_OF_DATE><YEAR>1960</YEAR></INDIVIDUAL_DATE_OF_BIRTH><INDIVIDUAL_PLACE_OF_BIRTH><CITY>Oslo</CITY><COUNTRY>Norway</COUNTRY></INDIVIDUAL_PLACE_OF_BIRTH>
<INDIVIDUAL_DOCUMENT><TYPE_OF_DOCUMENT>Passport</TYPE_OF_DOCUMENT><NUMBER>0035011785</NUMBER><COUNTRY_OF_ISSUE>Norway</COUNTRY_OF_ISSUE></INDIVIDUAL_DOCUMENT><INDIVIDUAL_ADDRESS><CITY>Oslo</CITY></INDIVIDUAL_ADDRESS></INDIVIDUAL>
<INDIVIDUAL><DATAID></DATAID></INDIVIDUAL></INDIVIDUALS><ENTITIES><ENTITY><DATAID>9</DATAID><FIRST_NAME>Firm</FIRST_NAME><REASON_FOR_LISTING>r</REASON_FOR_LISTING><ENTITY_ALIAS><QUALITY>a.k.a.</QUALITY><ALIAS_NAME>Firma</ALIAS_NAME></ENTITY_ALIAS></ENTITY></ENTITIES></CONSOLIDATED_LIST>"""
US = """<?xml version="1.0"?><sdnList><publshInformation><Publish_Date>01/04/2024</Publish_Date></publshInformation><sdnEntry><uid>7</uid><firstName>Ann</firstName><lastName>BERG</lastName><sdnType>Individual</sdnType>
<programList><program>P1</program><program>P2</program></programList><akaList><aka><category>strong</category><lastName>BERGA</lastName></aka><aka><category>weak</category><firstName>A</firstName><lastName>B</lastName></aka></akaList>
<addressList><address><address1>Road 1</address1><city>Oslo</city><postalCode>0150</postalCode><country>Norway</country></address></addressList><dateOfBirthList><dateOfBirthItem><dateOfBirth>03 Feb 1960</dateOfBirth></dateOfBirthItem></dateOfBirthList>
<idList><id><idType>Passport</idType><idNumber>0012</idNumber><idCountry>Norway</idCountry><expirationDate>30 Jun 2001</expirationDate></id><id><idType>Passport</idType><idNumber>13</idNumber><expirationDate>Feb 2001 to 2030</expirationDate></id><id><idType>Secondary sanctions risk:</idType><idNumber>x</idNumber></id></idList>
<nationalityList><nationality><country>Norway</country></nationality></nationalityList><citizenshipList><citizenship><country>Norway</country></citizenship><citizenship><country>Sweden</country></citizenship></citizenshipList></sdnEntry>
<sdnEntry><uid>8</uid><lastName>Ship</lastName><sdnType>Vessel</sdnType></sdnEntry></sdnList>"""
UK = """<?xml version="1.0"?><Designations><DateGenerated>05/01/2024</DateGenerated><Designation><UniqueID>AFG0001</UniqueID><UNReferenceNumber>TAi.1</UNReferenceNumber><RegimeName>Reg</RegimeName><IndividualEntityShip>Individual</IndividualEntityShip><OtherInformation>oi</OtherInformation>
<Names><Name><Name6>ALIAS</Name6><NameType>Alias</NameType></Name><Name><Name1>Ann</Name1><Name6>BERG</Name6><NameType>Primary name</NameType></Name></Names><NonLatinNames><NonLatinName><NameNonLatinScript>Анн</NameNonLatinScript></NonLatinName></NonLatinNames>
<Addresses><Address><AddressLine1>Road 1</AddressLine1><AddressLine2>Oslo</AddressLine2><AddressPostalCode>0150</AddressPostalCode><AddressCountry>Norway</AddressCountry></Address></Addresses>
<IndividualDetails><Individual><DOBs><DOB>12/11/1967</DOB><DOB>12/11/1967</DOB><DOB>dd/mm/1968</DOB><DOB>dd/09/1958</DOB><DOB>1985</DOB><DOB>odd</DOB></DOBs><Nationalities><Nationality>Norway</Nationality></Nationalities><BirthDetails><Location><TownOfBirth>Oslo</TownOfBirth><CountryOfBirth>Norway</CountryOfBirth></Location></BirthDetails>
<PassportDetails><Passport><PassportNumber> D0009720</PassportNumber></Passport></PassportDetails></Individual></IndividualDetails></Designation><Designation><UniqueID></UniqueID></Designation>
<Designation><UniqueID>S1</UniqueID><IndividualEntityShip>Ship</IndividualEntityShip><ShipDetails><Ship><IMONumbers><IMONumber>0075258</IMONumber></IMONumbers></Ship></ShipDetails></Designation></Designations>"""
CH = """<?xml version="1.0"?><target-list date="2024-01-06"><target ssid="10"><individual><identity main="true"><name name-type="primary-name" quality="good" lang="de"><name-part order="2"><value>Berg</value><spelling-variant lang="ru" script="Cyrl">Берг</spelling-variant></name-part>
<name-part order="1"><value>Ann</value><spelling-variant lang="ru" script="Cyrl">Анн</spelling-variant></name-part></name><name name-type="alias" quality="low"><name-part><value>A</value></name-part></name><day-month-year day="3" month="2" year="1960"/><day-month-year year="1961" circa="true"/>
<identification-document document-type="passport"><number>0099</number><issuer>NO</issuer></identification-document><address><street>Road 1</street><zip-code>0150</zip-code><city>Oslo</city></address></identity><justification>j1</justification><justification>j2</justification></individual>
<modification modification-type="de-listed" effective-date="2023-01-01"/><modification modification-type="listed" publication-date="2020-01-01"/></target><target ssid="11"><object object-type="vessel"><identity><name name-type="primary-name"><name-part><value>Ship</value></name-part></name></identity></object></target><target><entity/></target></target-list>"""


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def rows(df):
    return {r.id: r for r in df.collect()}


def names(r):
    return [(n.whole_name, n.strong) for n in r.names]


def test_eu(spark, tmp_path):
    got = rows(read_eu(spark, write(tmp_path, "eu.xml", EU)))
    assert set(got) == {"EU-13", "EU-14"}
    r = got["EU-13"]
    assert r.type == "individual" and names(r) == [("Ann Berg", True), ("Наме", True), ("Weak One", False)] and r.names[0].title == "Ms" and r.names[0].func == "Chair"
    assert r.birth_dates[0].raw == "1960-02-03" and r.birth_dates[0].birth_day == 3 and r.birth_dates[1].year_range_to == 1962 and r.birth_dates[1].circa
    assert r.places_of_birth == ["Oslo"] and r.citizenships == ["SWEDEN"] and r.united_nation_id is None and r.eu_reference_number == "EU.1.2"
    assert [a.full_address for a in r.addresses] == ["Road 1, Oslo, 0150, NORWAY"] and r.contact_info.emails == ["a@b.no"] and r.identifications[0].number == "0035" and r.identifications[0].known_false
    assert r.regulation.url == "http://x" and r.sanction_reason == "2020/1" and r.legal_basis == "http://x"
    assert names(got["EU-14"]) == [("Unknown Name", False)] and got["EU-14"].regulation is None and got["EU-14"].contact_info is None


def test_un(spark, tmp_path):
    got = rows(read_un(spark, write(tmp_path, "un.xml", UN)))
    assert set(got) == {"UN-0075", "UN-9"}
    r = got["UN-0075"]
    assert names(r)[0][0] == "Ann Berg" and dict(names(r))["A Berg"] and not dict(names(r))["Anna"] and r.citizenships == ["Norway"] and r.birth_dates[0].raw == "1960" and r.sanction_reason == "why"
    assert r.identifications[0].number == "0035011785" and r.identifications[0].country_iso2 == "Norway" and r.places_of_birth == ["Oslo, Norway"]
    assert got["UN-9"].type == "entity" and got["UN-9"].sanction_reason == "r" and not dict(names(got["UN-9"]))["Firma"]


def test_us(spark, tmp_path):
    got = rows(read_us(spark, write(tmp_path, "us.xml", US), "2024-01-01"))
    r = got["US-SDN-7"]
    assert names(r)[0][0] == "Ann BERG" and dict(names(r))["BERGA"] and not dict(names(r))["A B"] and r.citizenships == ["Norway", "Sweden"] and r.sanction_reason == "P1, P2"
    assert [(i.number, i.known_expired) for i in r.identifications] == [("0012", True), ("13", False)] and r.addresses[0].full_address == "Road 1, Oslo, 0150, Norway" and got["US-SDN-8"].type == "vessel"


def test_uk(spark, tmp_path):
    got = rows(read_uk(spark, write(tmp_path, "uk.xml", UK)))
    assert set(got) == {"UK-AFG0001", "UK-S1"}
    r = got["UK-AFG0001"]
    assert names(r) == [("Ann BERG", True), ("ALIAS", False), ("Анн", False)] and r.identifications[0].number == "D0009720" and r.addresses[0].street == "Road 1, Oslo"
    assert [(b.raw, b.birth_year, b.birth_month) for b in r.birth_dates] == [("1967-11-12", 1967, 11), (None, 1968, None), (None, 1958, 9), (None, 1985, None)]
    assert got["UK-S1"].type == "vessel" and got["UK-S1"].identifications[0].number == "0075258" and got["UK-S1"].identifications[0].type_description == "IMO Number"


def test_ch(spark, tmp_path):
    got = rows(read_ch(spark, write(tmp_path, "ch.xml", CH)))
    assert set(got) == {"CH-10", "CH-11"}
    r = got["CH-10"]
    assert names(r) == [("Ann Berg", True), ("Анн Берг", True), ("A", False)] and r.status == "delisted" and r.delisted_at == "2023-01-01" and r.listed_at == "2020-01-01" and r.sanction_reason == "j1; j2"
    assert [(b.raw, b.circa) for b in r.birth_dates] == [("1960-02-03", None), ("1961", True)] and r.addresses[0].region == "0150" and r.identifications[0].issued_by == "NO" and got["CH-11"].type == "vessel" and got["CH-11"].status == "active"


def test_ua(spark, tmp_path):
    people = {"data": [{"id": 5, "lastName": "Берг", "firstName": "Анн", "dateOfBirth": "1960-02-03", "passports": [{"series": "АБ", "number": "001234"}], "ipn": "0123", "aliases": [{"lastName": "Berg"}], "status": "revoked", "decree": {"number": "1", "date": "2020-01-01", "url": "u"}}], "totalPages": 1}
    firms = {"data": [{"id": 6, "shortName": "ТОВ", "edrpou": "00123", "status": "active"}], "totalPages": 1}
    got = rows(read_ua(spark, write(tmp_path, "p.json", json.dumps(people)), write(tmp_path, "e.json", json.dumps(firms))))
    r = got["UA-5"]
    assert names(r) == [("Берг Анн", True), ("Berg", False)] and r.status == "delisted" and [i.number for i in r.identifications] == ["АБ001234", "0123"] and r.regulation.number_title == "Decree 1" and r.birth_dates[0].birth_month == 2
    assert names(got["UA-6"]) == [("ТОВ", True)] and got["UA-6"].identifications[0].number == "00123"


def test_csv(spark, tmp_path):
    text = "﻿Key;FullName;aliases;type;source;dob;ssn;city\r\nA-1;\"Berg; \"\"Ann\"\"\";A|B| ;Bolag;pep;1960|1961;007;Oslo;extra\r\n\r\nA-2;X\nA-3;;;;;;;\nA-4;N;;;UN;;;\nA 5;N;;;;;;\nA-6;N;;vessel;;;;\n"
    good, bad = read_csv_list(spark, write(tmp_path, "x.csv", text))
    got = rows(good)
    assert set(got) == {"PEP-A-1", "PEP-A-6"} and got["PEP-A-6"].type == "vessel"
    r = got["PEP-A-1"]
    assert names(r) == [('Berg; "Ann"', True), ("A", False), ("B", False)] and r.type == "entity" and [b.raw for b in r.birth_dates] == ["1960", "1961"] and r.identifications[0].number == "007" and r.addresses[0].full_address == "Oslo"
    assert sorted((b.row_no, b.reason) for b in bad.collect()) == [(2, "malformedColumns"), (3, "missingName"), (4, "sourceMismatch"), (5, "invalidId")]
    none, also = read_csv_list(spark, write(tmp_path, "none.csv", "\n"))
    assert none.count() == 0 and also.count() == 0
    keyless, _ = read_csv_list(spark, write(tmp_path, "k.csv", "name\nAnn\nBo\n"))
    assert set(rows(keyless)) == {"PEP-row-1", "PEP-row-2"}


def test_formats_paths_lines(spark, tmp_path):
    d = tmp_path / "f"
    d.mkdir()
    for n, x in (("eu", EU), ("un", UN), ("us", US), ("uk", UK), ("ch", CH), ("c1", "Date_file;x\n2024-01-07;y"), ("csv", "id;name\n1;x"), ("odd", "<?xml version='1.0'?><other/>")):
        write(d, n, x)
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.generated_at) for r in formats(spark, str(d)).collect()}
    assert got == {"eu": ("eu-xml-1.1", "2024-01-02T00:00:00"), "un": ("un-xml", "2024-01-03"), "us": ("us-xml", "01/04/2024"), "uk": ("uk-xml", "05/01/2024"), "ch": ("ch-xml", "2024-01-06"), "c1": ("eu-csv-1.0", "2024-01-07"), "csv": ("csv", None), "odd": ("csv", None)}
    assert confined_path("f/eu", str(tmp_path)).endswith("/f/eu")
    for bad in ("../x", "/etc/passwd", "a\0b", "."):
        with pytest.raises(ValueError):
            confined_path(bad, str(tmp_path))
    assert [r.name for r in query_lines(spark, write(tmp_path, "q.txt", " Ann \n\n# no\nBo\n")).orderBy("q_id").collect()] == ["Ann", "Bo"]
