"""Queries p8, p9 and p10 over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.llm import mixing, packing, splitting, tokens
from rosterspark.session import checkpointed, table

CAPACITY = 2048
MIX_SEED = 20240229
PIECE_LIMIT = 1024
PIECE_OVERLAP = 64
#: Texts of more bytes than this, about half of those over the limit, are taken by ranges of it.
PIECE_RANGE = 1 << 14


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = checkpointed(tokens.with_sizes(table(spark, sf_dir, "documents"), "text", ["doc_id"]))
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p8_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, sf_dir), CAPACITY)


def _mix_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[dict]]:
    targets = table(spark, sf_dir, "mix_target")
    docs = table(spark, sf_dir, "documents")
    wanted = [r.source for r in targets.select("source").where("source is not null").distinct().collect()]
    sizes = checkpointed(tokens.with_sizes(docs.where(F.col("source").isin(wanted)), "text", ["doc_id", "source"]))
    return docs, sizes, mixing.plan(mixing.tokens_by_chance(sizes, "doc_id", MIX_SEED), targets)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, planned = _mix_inputs(spark, sf_dir)
    return mixing.mix(docs.select("doc_id", "source", "text"), "doc_id", planned, MIX_SEED)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sizes, planned = _mix_inputs(spark, sf_dir)
    return mixing.shares(sizes, "doc_id", planned, MIX_SEED)


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", PIECE_LIMIT, PIECE_OVERLAP, range_bytes=PIECE_RANGE).where("n_pieces > 1")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text over the limit has exactly one piece 1 in the table of pieces."""
    pieces = splitting.split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", PIECE_LIMIT, PIECE_OVERLAP, range_bytes=PIECE_RANGE, with_piece=False)
    return pieces.where("piece_no = 1").select("doc_id")


QUERIES = {"p8_pack": p8_pack, "p8_fill_report": p8_fill_report, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_pieces": p10_pieces}
