"""Temporal event algebra over observation logs, as Spark DataFrame operators."""
