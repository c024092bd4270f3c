"""Raw list lines into parsed rows and rejected lines with the reason.

Blocks of lines with the same header are parsed and checked as a whole on Arrow columns. A block in
which anything fails is halved, and its halves are tried, until a single bad line is left; only that
line is read by the strict parser, which names the reason. Blocks follow the partitioning of the
input, so an upload of any size spreads over all tasks.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pa_csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.session import bounded_broadcast

#: Lines in a block of the fast path.
BLOCK_LINES = 1024

# Header names of each list column, as the list format defines them.
HEADERS = {
    "id": ["id", "key", "uid"],
    "name": ["name", "primaryname", "fullname", "wholename"],
    "aliases": ["aliases", "alias"],
    "type": ["type", "category"],
    "source": ["source"],
    "dates_of_birth": ["datesofbirth", "dob", "birthdate"],
    "citizenships": ["citizenships", "citizenship", "nationality"],
    "passports": ["passports", "passport", "idnumbers", "ssn", "pnr"],
    "full_address": ["fulladdress"],
    "reason": ["reason", "role", "description", "position"],
}
TYPES = ("individual", "entity", "vessel", "aircraft")
SEPARATORS = (";", ",", "\t", "|")
FIELDS = tuple(HEADERS)

_BLANK = " \t\r\n\v\f ﻿"
_ID = re.compile(r"[A-Za-z0-9_-]+")
_RESERVED = re.compile(r"__.*__")

PARSED = pa.schema([("upload_id", pa.string()), ("line_no", pa.int64()), ("failure", pa.string()), *[(f, pa.string()) for f in FIELDS]])
PARSED_DDL = "upload_id string, line_no long, failure string, " + ", ".join(f"{f} string" for f in FIELDS)


def separator_of(header: str) -> str:
    """The separator that the header holds most often outside quotes; ``;`` if none."""
    bare = re.sub(r'"[^"]*"', "", header)
    best = max(SEPARATORS, key=bare.count)
    return best if bare.count(best) else ";"


def strict_values(line: str, sep: str) -> list[str] | None:
    """The values of a line, or None if a quote stands where none may.

    A quote may enclose a whole value (blanks outside it are ignored) or stand doubled inside an enclosed one.
    """
    values, i, n = [], 0, len(line)
    while True:
        while i < n and line[i] in _BLANK and line[i] != sep:
            i += 1
        if i < n and line[i] == '"':
            i, out = i + 1, []
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                out.append(line[i:j])
                if j + 1 < n and line[j + 1] == '"':
                    out.append('"')
                    i = j + 2
                    continue
                i = j + 1
                break
            while i < n and line[i] in _BLANK and line[i] != sep:
                i += 1
            if i < n and line[i] != sep:
                return None
            values.append("".join(out).strip(_BLANK))
        else:
            j = line.find(sep, i)
            j = n if j < 0 else j
            value = line[i:j]
            if '"' in value:
                return None
            values.append(value.strip(_BLANK))
            i = j
        if i >= n:
            return values
        i += 1


class Header:
    """A header line, read once per upload and task."""

    def __init__(self, line: str):
        line = line.strip("\r\n").lstrip("﻿")
        self.sep = separator_of(line)
        names = strict_values(line, self.sep) or line.split(self.sep)
        self.names = [re.sub(r"[\s_]+", "", x.strip(_BLANK + '"').lower()) for x in names]
        self.place = {f: next((self.names.index(a) for a in known if a in self.names), None) for f, known in HEADERS.items()}
        sep = re.escape(self.sep)
        # RE2: each value is without quotes, or enclosed with doubled quotes inside; no blanks beside the quotes
        value = rf'(?:[^"{sep}]*|"(?:[^"]|"")*")'
        self.well_quoted = rf"^{value}(?:{sep}{value})*$"


def diagnose(line: str, header: Header, default_source: str) -> tuple[str | None, dict[str, str | None]]:
    """The first reason that applies (None if loadable) and the values by field."""
    values = strict_values(line, header.sep)
    if values is None:
        return "quoting", {}
    if len(values) != len(header.names):
        return "columns", {}
    row = {f: values[i] if i is not None else None for f, i in header.place.items()}
    key = row["id"]
    if key is not None or header.place["id"] is not None:
        if not key or not _ID.fullmatch(key) or _RESERVED.fullmatch(key):
            return "id", {}
    if row["source"] and row["source"].upper() != (default_source or "").strip(_BLANK).upper():
        return "source", {}
    if row["type"] and row["type"].lower() not in TYPES:
        return "type", {}
    return None, row


def _trimmed(x: pa.ChunkedArray) -> pa.ChunkedArray:
    return pc.utf8_trim(x, _BLANK)


def _all(x) -> bool:
    return bool(pc.all(pc.fill_null(x, False), min_count=0).as_py())


def _fast(lines: pa.Array, header: Header, default_source: str) -> dict[str, pa.Array] | None:
    """The block's columns, or None if any of its lines may be bad."""
    if not _all(pc.match_substring_regex(lines, header.well_quoted)):
        return None
    width = len(header.names)
    names = [f"c{i}" for i in range(width)]
    text = "\n".join(lines.to_pylist()) + "\n"
    try:
        read = pa_csv.read_csv(
            io.BytesIO(text.encode()),
            read_options=pa_csv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, 4 * len(text) + 1024)),
            parse_options=pa_csv.ParseOptions(delimiter=header.sep, quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False),
            convert_options=pa_csv.ConvertOptions(column_types={c: pa.string() for c in names}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if read.num_rows != len(lines):
        return None
    out = {f: _trimmed(read.column(f"c{i}")) if i is not None else None for f, i in header.place.items()}
    if out["id"] is not None:
        if not _all(pc.match_substring_regex(out["id"], r"^[A-Za-z0-9_-]+$")) or not _all(pc.invert(pc.match_substring_regex(out["id"], r"^__.*__$"))):
            return None
    if out["source"] is not None:
        source = pc.utf8_upper(out["source"])
        if not _all(pc.or_(pc.equal(source, ""), pc.equal(source, (default_source or "").strip(_BLANK).upper()))):
            return None
    if out["type"] is not None and not _all(pc.is_in(pc.utf8_lower(out["type"]), pa.array(["", *TYPES]))):
        return None
    return out


def _try(lines: pa.Array, numbers: pa.Array, header: Header, default_source: str, upload: str, out: list[pa.RecordBatch]) -> None:
    todo = [(0, len(lines))]
    while todo:
        a, b = todo.pop()
        part, no = lines.slice(a, b - a), numbers.slice(a, b - a)
        if b - a == 1:
            reason, row = diagnose(part[0].as_py(), header, default_source)
            out.append(pa.RecordBatch.from_arrays([pa.array([upload]), no, pa.array([reason], pa.string()), *[pa.array([row.get(f)], pa.string()) for f in FIELDS]], schema=PARSED))
            continue
        got = _fast(part, header, default_source)
        if got is None:
            middle = (a + b) // 2
            todo += [(middle, b), (a, middle)]
            continue
        n = b - a
        columns = [got[f].combine_chunks() if got[f] is not None else pa.nulls(n, pa.string()) for f in FIELDS]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        out.append(pa.RecordBatch.from_arrays([pa.array([upload] * n), no, pa.nulls(n, pa.string()), *columns], schema=PARSED))


def _parse(block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers: dict[str, Header] = {}
        for batch in batches:
            out: list[pa.RecordBatch] = []
            groups = batch.column("upload_id").dictionary_encode()
            for code, upload in enumerate(groups.dictionary.to_pylist()):
                mine = batch.filter(pc.equal(groups.indices, code))
                head, source = mine.column("header")[0].as_py(), mine.column("default_source")[0].as_py()
                header = headers.get(upload)
                if header is None:
                    header = headers[upload] = Header(head)
                    if len(headers) > 1024:
                        headers.clear()
                lines, numbers = mine.column("line"), mine.column("line_no").cast(pa.int64())
                for at in range(0, len(lines), block_lines):
                    _try(lines.slice(at, block_lines), numbers.slice(at, block_lines), header, source, upload, out)
            yield from out

    return run


def parse_uploads(raw: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(upload_id, line_no, failure, fields...) of every line that is neither header nor blank.

    ``raw``: upload_id, line_no (1 = header), default_source, line. ``failure`` is null for loadable lines,
    else the first that applies of quoting, columns, id, source, type; the fields are then null.
    Lines of an upload without a header line have no result, as nothing says what they hold; repeated
    lines are judged each for itself; a null line is blank. Other columns are ignored.
    """
    slim = raw.select("upload_id", F.col("line_no").cast("long").alias("line_no"), "default_source", F.regexp_replace("line", r"[\r\n]+$", "").alias("line"))
    blank = r"^[\s ﻿]*$"
    head = slim.where("line_no = 1").groupBy("upload_id").agg(F.max("line").alias("header"))
    body = slim.where((F.col("line_no") > 1) & ~F.coalesce(F.col("line"), F.lit("")).rlike(blank))
    # headers are one line an upload: broadcast while they are small, else joined with AQE's skew splitting
    return body.join(bounded_broadcast(head), "upload_id").select("upload_id", "line_no", "default_source", "line", "header").mapInArrow(_parse(block_lines), PARSED_DDL)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("failure is not null").select("upload_id", "line_no", F.col("failure").alias("reason"))


def loadable(parsed: DataFrame) -> DataFrame:
    return parsed.where("failure is null").drop("failure")
