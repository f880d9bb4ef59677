"""Queries over the test tables, with SQL twins."""

from . import growth_queries, metric_queries, model_queries, source_queries, training_queries  # noqa: F401
