"""Spark-first analytics over tiered storage: page plans, vault roll-ups, ledgers, search and data-pipeline operators."""

__version__ = "0.1.0"
