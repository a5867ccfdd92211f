"""All registered queries of the library and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curation_queries, model_queries, record_queries, text_queries, vector_queries

_ALL = curation_queries.PAIRS | text_queries.PAIRS | vector_queries.PAIRS | record_queries.PAIRS | model_queries.PAIRS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: pair[0] for name, pair in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: pair[1] for name, pair in _ALL.items() if pair[1]}
FLAGSHIP = "label_distribution_by_year"
