"""Queries and SQL twins of the llm problems, for the entry file."""

from rosterspark.llm import entity_queries, text_queries

QUERIES = {**entity_queries.QUERIES, **text_queries.QUERIES}
ORACLES: dict[str, str] = {}
