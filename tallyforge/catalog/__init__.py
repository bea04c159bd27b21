"""Queries over the given tables, one for each operator, with the SQL each is checked against."""

from tallyforge.catalog import aggregates, bucketed, commits, extras, feeds, inbox, ingestion, joins, late, normalisers, plans, records, search, sinks, sources, stores, texts, windows  # noqa: F401
