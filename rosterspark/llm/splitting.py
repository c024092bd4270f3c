"""Texts over a token limit cut into overlapping pieces at natural boundaries, by byte ranges.

A text is seen as byte ranges with halos, so no worker needs the whole of a giant one. A range owns
the words that begin in it. First each range counts its tokens; prefix sums over a text's ranges give
every range its token offset and the text its number of cuts. Cut i is the best boundary (paragraph,
then sentence or line, then word) in the token window just before i * total / pieces: ranges offer
their best candidate of each window they touch, and the stitched table keeps one per window. No cut
depends on another, so nothing is sequential in the length of a text. Pieces are emitted by offset.
Texts of one range take the same steps in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterspark.llm.tokens import Tokenizer, tokenizer, tokenizer_path
from rosterspark.session import checkpointed

RANGE_BYTES = 1 << 18
#: Bytes before a range that are read to find where an overlap begins, and after it to end its last word.
LEFT_HALO = 1 << 13
RIGHT_HALO = 1 << 10

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:;>"]] = True
PARAGRAPH, SENTENCE, WORD, HARD = 3, 2, 1, 0


def owned(raw: np.ndarray, lead: int, length: int, first: bool, last: bool) -> tuple[int, int]:
    """Of a range's bytes with halos, begin and end (in ``raw``) of the words it owns.

    ``lead``: bytes of left halo. A word begins at the blanks before it. The word that crosses an edge is owned
    by the range it begins in, if it ends within the right halo; else both sides cut it at the edge.
    """

    def edge(at: int) -> int:
        if at >= len(raw):
            return len(raw)
        if _SPACE[raw[at]] and at > 0 and not _SPACE[raw[at - 1]]:
            return at
        tail = raw[at : at + RIGHT_HALO]
        # within blanks: those belong to the word after them, which began at the first blank
        inside = at > 0 and _SPACE[raw[at - 1]]
        blank = _SPACE[tail]
        if inside:
            solid = np.flatnonzero(~blank)
            if len(solid) == 0:
                return _whole_char(raw, at)
            blank = blank.copy()
            blank[: solid[0]] = False
        hits = np.flatnonzero(blank)
        return at + int(hits[0]) if len(hits) else _whole_char(raw, at)

    begin = 0 if first else edge(lead)
    end = len(raw) if last else edge(lead + length)
    return begin, end


def _whole_char(raw: np.ndarray, at: int) -> int:
    while at < len(raw) and 0x80 <= raw[at] < 0xC0:
        at += 1
    return at


def _levels(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How natural a cut before each byte ``at`` (> 0) is."""
    before, here = raw[at - 1], raw[at]
    starts = _SPACE[here] & ~_SPACE[before]
    level = np.where(starts, WORD, HARD).astype(np.int8)
    line = (here == 10) | (here == 13)
    level[starts & (_STOP[before] | line)] = SENTENCE
    next1, next2 = raw[np.minimum(at + 1, len(raw) - 1)], raw[np.minimum(at + 2, len(raw) - 1)]
    double = ((here == 10) & ((next1 == 10) | (next1 == 13))) | ((here == 13) & (next1 == 10) & (next2 == 13))
    level[starts & double] = PARAGRAPH
    return level


def _boundaries(raw: np.ndarray, begin: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (from ``begin``) where a piece may end, tokens before each, and levels.

    ``ends``: byte ends, from ``begin``, of the tokens there; ``begin`` itself is a boundary unless it begins the text.
    """
    at = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    tokens = np.arange(len(at))
    if begin == 0:
        at, tokens = at[1:], tokens[1:]
    level = _levels(raw, at + begin)
    here = raw[at + begin]
    keep = (level > HARD) | (here < 0x80) | (here >= 0xC0)
    return at[keep], tokens[keep], level[keep]


class Plan:
    """Where cuts may fall for a text of ``total`` tokens."""

    def __init__(self, total: int, limit: int, overlap: int):
        self.slack = max(1, limit // 8)
        self.step = limit - overlap - self.slack
        self.cuts = 0 if total <= limit else -(-total // self.step) - 1
        self.every = total / (self.cuts + 1)

    def windows(self, begin: int, end: int) -> range:
        """Numbers of the windows (i * every - slack, i * every] that meet the tokens (begin, end]."""
        low = int(np.floor(begin / self.every)) if self.cuts else 0
        high = int(np.ceil((end + self.slack) / self.every)) if self.cuts else 0
        return range(max(1, low), min(self.cuts, high) + 1)


def candidates(raw: np.ndarray, t: Tokenizer, lead_begin: int, begin: int, end: int, offset: int, plan: Plan, overlap: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best cut of each window within the owned bytes: (window, level, tokens, byte, overlap's byte, overlap's tokens).

    Bytes are offsets in ``raw``; tokens count from the text's begin; ``raw[lead_begin:begin]`` is the halo in
    which an overlap may begin.
    """
    body = raw[begin:end]
    ends = t.ends(body.tobytes().decode("utf-8", "replace")) if len(body) else np.empty(0, np.int64)
    if len(ends) == 0 or ends[-1] != len(body):
        return []
    at, tokens, level = _boundaries(raw, begin, ends)
    tokens = tokens + offset
    words_at, words_tokens = at[level > HARD], tokens[level > HARD]
    halo_at = halo_tokens = None
    out = []
    for i in plan.windows(offset, offset + len(ends)):
        high, low = int(i * plan.every), int(i * plan.every) - plan.slack
        a, b = np.searchsorted(tokens, low, side="right"), np.searchsorted(tokens, high, side="right")
        if a == b:
            continue
        best = a + int(np.lexsort((tokens[a:b], level[a:b]))[-1])
        cut, cut_tokens = int(at[best]), int(tokens[best])
        start, start_tokens = cut, cut_tokens
        if overlap:
            k = int(np.searchsorted(words_tokens, cut_tokens - overlap, side="left"))
            if k < len(words_tokens) and words_tokens[k] < cut_tokens:
                start, start_tokens = int(words_at[k]), int(words_tokens[k])
            if k == 0 and begin > lead_begin and offset > cut_tokens - overlap:
                if halo_at is None:
                    halo_at, halo_tokens = _halo(raw, t, lead_begin, begin, offset)
                j = int(np.searchsorted(halo_tokens, cut_tokens - overlap, side="left"))
                if j < len(halo_tokens):
                    start, start_tokens = int(halo_at[j]) - begin, int(halo_tokens[j])
        out.append((i, int(level[best]), cut_tokens, begin + cut, begin + start, start_tokens))
    return out


def _halo(raw: np.ndarray, t: Tokenizer, lead_begin: int, begin: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Word boundaries of the left halo with their tokens, counted back from the range's offset."""
    part = raw[lead_begin:begin]
    starts = np.flatnonzero(_SPACE[part[1:]] & ~_SPACE[part[:-1]]) + 1
    if len(starts) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    from_byte = lead_begin + int(starts[0])
    ends = t.ends(raw[from_byte:begin].tobytes().decode("utf-8", "replace"))
    at, tokens, level = _boundaries(raw, from_byte, ends)
    return at[level > HARD] + from_byte, offset - (len(ends) - tokens[level > HARD])


def _pieces_of(cuts: list[tuple[int, int, int, int, int, int]], total: int, size: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, begin byte, end byte, tokens, overlap tokens) from the cuts of a text in order."""
    out, begin, begin_tokens, last_tokens = [], 0, 0, 0
    for _, _, tokens, at, start, start_tokens in cuts:
        out.append((len(out), begin, at, tokens - begin_tokens, last_tokens - begin_tokens))
        begin, begin_tokens, last_tokens = start, start_tokens, tokens
    out.append((len(out), begin, size, total - begin_tokens, last_tokens - begin_tokens))
    return out


def split_text(text: str, t: Tokenizer, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """The pieces of one text in one range; the text whole if within the limit."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    total = t.count(text)
    p = Plan(total, limit, overlap)
    found = candidates(raw, t, 0, 0, len(raw), 0, p, overlap) if p.cuts else []
    return _pieces_of(found, total, len(raw))


_PIECE = "piece_no int, n_pieces int, begin_byte long, end_byte long, n_tokens long, overlap_tokens long, piece string"


def split_texts(df: DataFrame, key: str, text: str, limit: int, overlap: int, path: str | None = None, range_bytes: int = RANGE_BYTES, with_piece: bool = True) -> DataFrame:
    """(key, piece_no, n_pieces, begin_byte, end_byte, n_tokens, overlap_tokens, piece) of every text.

    A text of at most ``limit`` tokens comes out whole as piece 0 of 1 (so do empty ones; a null text gives no
    piece). Pieces hold at most ``limit`` tokens and repeat about ``overlap`` tokens of the one before, from a
    word's begin. Without any blank in a window the cut is hard, between two tokens and never within a character.
    A text of no more bytes than ``limit`` needs no tokenizer to be known as whole: no token is empty.
    Texts of more than ``range_bytes`` are taken by ranges. Without ``with_piece``, the table of pieces alone is made.
    """
    _checked(limit, overlap)
    path = path or tokenizer_path()
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    rows = df.select(F.col(key).alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    size = F.octet_length("text")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            out: list[tuple] = []
            for item, x in zip(b["item"], b["text"]):
                raw = x.encode()
                if len(raw) <= limit:
                    out.append((item, 0, 1, 0, len(raw), t.count(x), 0, x))
                    continue
                found = split_text(x, t, limit, overlap)
                for no, begin, end, n, over in found:
                    out.append((item, no, len(found), begin, end, n, over, raw[begin:end].decode("utf-8", "replace") if with_piece else None))
            yield pd.DataFrame(out, columns=["item", "piece_no", "n_pieces", "begin_byte", "end_byte", "n_tokens", "overlap_tokens", "piece"])

    small = rows.where(size <= range_bytes).mapInPandas(local, f"item {kind}, {_PIECE}")
    # ranges of one text leave the task that read it and spread over all; a text is known by its own hash and its key
    named = F.concat(F.lpad(F.hex(F.xxhash64("text")), 16, "0"), F.col("item").cast("string"))
    cut_up = ranges(rows.where(size > range_bytes).select(named.alias("item"), "text"), range_bytes).repartition("item", "range_no")
    big = _split_ranges(cut_up, limit, overlap, path, range_bytes, with_piece)
    out = small.unionByName(big.withColumn("item", F.substring("item", F.lit(17), F.length("item")).cast(kind)))
    return (out if with_piece else out.drop("piece")).withColumnRenamed("item", key)


def split_files(spark: SparkSession, files: str, limit: int, overlap: int, path: str | None = None, range_bytes: int = RANGE_BYTES, with_piece: bool = True) -> DataFrame:
    """``split_texts`` of whole UTF-8 files (path, piece_no, ...): each worker reads the bytes of its ranges alone, no file is ever a row.

    ``files``: a path or pattern that all executors can read. Empty files give no piece: Spark does not list them.
    """
    _checked(limit, overlap)
    listed = spark.read.format("binaryFile").load(files).select(F.col("path").alias("item"), F.col("length").alias("size"))
    at = F.col("range_no") * F.lit(range_bytes)
    each = listed.where("size > 0").select("item", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {range_bytes})")).alias("range_no"))
    cut_up = each.select("item", F.col("range_no").cast("int").alias("range_no"), at.alias("at"), F.least(at, F.lit(LEFT_HALO)).cast("int").alias("lead"), F.least(F.lit(range_bytes), F.col("size") - at).cast("int").alias("length"), "size", F.lit(None).cast("binary").alias("raw"))
    cut_up = cut_up.repartition("item", "range_no")
    out = _split_ranges(cut_up, limit, overlap, path or tokenizer_path(), range_bytes, with_piece)
    return (out if with_piece else out.drop("piece")).withColumnRenamed("item", "path")


def _checked(limit: int, overlap: int) -> None:
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and below half the limit")


def read_range(file: str, at: int, length: int) -> bytes:
    """Bytes of a file from ``at``, by its path or address."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file://") else file)
    with where.open_input_file(name) as f:
        return f.read_at(min(length, max(0, f.size() - at)), at)


def ranges(rows: DataFrame, range_bytes: int) -> DataFrame:
    """(item, range_no, at, lead, length, size, raw): each text's byte ranges with halos. A slice of binary costs its own length."""
    b = rows.select("item", F.encode("text", "UTF-8").alias("b")).select("item", "b", F.length("b").alias("size"))
    each = b.select("item", "b", "size", F.explode(F.expr(f"sequence(0, (size - 1) div {range_bytes})")).alias("range_no"))
    at = F.col("range_no") * F.lit(range_bytes)
    lead = F.least(at, F.lit(LEFT_HALO))
    return each.select(
        "item", "range_no", at.cast("long").alias("at"), lead.alias("lead"), F.least(F.lit(range_bytes), F.col("size") - at).cast("int").alias("length"), F.col("size").cast("long").alias("size"),
        F.col("b").substr(at - lead + 1, lead + F.lit(range_bytes + RIGHT_HALO)).alias("raw"),
    )


def _bytes_of(r) -> np.ndarray:
    return np.frombuffer(r.raw if r.raw is not None else read_range(r.item, r.at - r.lead, r.lead + r.length + RIGHT_HALO), dtype=np.uint8)


def _split_ranges(cut_up: DataFrame, limit: int, overlap: int, path: str, range_bytes: int, with_piece: bool) -> DataFrame:
    # repeated texts are worked on once and come out as often as they came
    cut_up = cut_up.groupBy("item", "range_no", "at", "lead", "length", "size").agg(F.first("raw").alias("raw"), F.count("*").alias("times"))
    kind = "string"

    def bounds(r) -> tuple[np.ndarray, int, int]:
        raw = _bytes_of(r)
        begin, end = owned(raw, r.lead, r.length, r.at == 0, r.at + r.length >= r.size)
        return raw, begin, max(begin, end)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                raw, begin, end = bounds(r)
                out.append((r.item, r.range_no, r.size, r.times, t.count(raw[begin:end].tobytes().decode("utf-8", "replace"))))
            yield pd.DataFrame(out, columns=["item", "range_no", "size", "times", "n"])

    counts = cut_up.mapInPandas(count, f"item {kind}, range_no int, size long, times long, n long")
    ordered = Window.partitionBy("item").orderBy("range_no")
    # rows of numbers, one per range: a text of a terabyte has four million
    offsets = checkpointed(counts.select("item", "range_no", "size", "times", (F.sum("n").over(ordered) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy("item")).alias("total")))

    def offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                p = Plan(r.total, limit, overlap)
                if not p.cuts:
                    continue
                raw, begin, end = bounds(r)
                shift = r.at - r.lead
                for i, level, tokens, at, start, start_tokens in candidates(raw, t, 0, begin, end, r.offset, p, overlap):
                    out.append((r.item, i, level, tokens, at + shift, start + shift, start_tokens))
            yield pd.DataFrame(out, columns=["item", "cut", "level", "tokens", "at", "start", "start_tokens"])

    offered = cut_up.join(offsets.drop("size", "times"), ["item", "range_no"]).mapInPandas(offer, f"item {kind}, cut int, level int, tokens long, at long, start long, start_tokens long")
    best = offered.groupBy("item", "cut").agg(F.max(F.struct("level", "tokens", "at", "start", "start_tokens")).alias("c"))
    whole = offsets.where("range_no = 0").select("item", "total", "size", "times")
    edge = Window.partitionBy("item").orderBy("cut")
    zero = F.lit(0).cast("long")
    firsts = whole.select("item", F.lit(0).alias("cut"), zero.alias("begin"), zero.alias("begin_tokens"), zero.alias("end_of"), zero.alias("end_tokens"))
    cuts = best.select("item", "cut", F.col("c.start").alias("begin"), F.col("c.start_tokens").alias("begin_tokens"), F.col("c.at").alias("end_of"), F.col("c.tokens").alias("end_tokens"))
    table = firsts.unionByName(cuts).join(whole, "item")
    pieces = table.select(
        "item",
        (F.row_number().over(edge) - 1).alias("piece_no"),
        F.count("*").over(Window.partitionBy("item")).cast("int").alias("n_pieces"),
        F.col("begin").alias("begin_byte"),
        F.coalesce(F.lead("end_of").over(edge), F.col("size")).alias("end_byte"),
        (F.coalesce(F.lead("end_tokens").over(edge), F.col("total")) - F.col("begin_tokens")).alias("n_tokens"),
        (F.col("end_tokens") - F.col("begin_tokens")).alias("overlap_tokens"),
        "times",
    )
    full = _emitted(checkpointed(pieces), cut_up, kind, range_bytes) if with_piece else pieces.withColumn("piece", F.lit(None).cast("string"))
    return full.withColumn("times", F.explode(F.expr("sequence(1L, times)"))).drop("times")


def _emitted(pieces: DataFrame, cut_up: DataFrame, kind: str, range_bytes: int) -> DataFrame:
    """``pieces`` with ``piece``: each range gives out its own bytes of the pieces that meet it, and these are put together. No row holds more than a range and its pieces' offsets."""
    meets = F.explode(F.expr(f"sequence(int(begin_byte div {range_bytes}), int(greatest(begin_byte, end_byte - 1) div {range_bytes}))"))
    wanted = pieces.select("item", meets.alias("range_no"), F.struct("piece_no", "begin_byte", "end_byte").alias("p")).groupBy("item", "range_no").agg(F.collect_list("p").alias("p"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                raw = _bytes_of(r)[r.lead : r.lead + r.length].tobytes()
                for p in r.p:
                    out.append((r.item, p["piece_no"], r.range_no, raw[max(p["begin_byte"] - r.at, 0) : max(p["end_byte"] - r.at, 0)]))
            yield pd.DataFrame(out, columns=["item", "piece_no", "range_no", "part"])

    parts = cut_up.join(wanted, ["item", "range_no"]).mapInPandas(cut, f"item {kind}, piece_no int, range_no int, part binary")
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("range_no", "part"))), F.lit(b""), lambda acc, x: F.concat(acc, x["part"]))
    text = parts.groupBy("item", "piece_no").agg(F.decode(joined, "UTF-8").alias("piece"))
    return pieces.join(text, ["item", "piece_no"]).select("item", "piece_no", "n_pieces", "begin_byte", "end_byte", "n_tokens", "overlap_tokens", "times", "piece")
