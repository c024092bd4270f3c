"""Watch-list data engine on Spark: ingest, diff, screen, overlay and export list records as DataFrames."""

__version__ = "0.1.0"
