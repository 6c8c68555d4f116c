"""Incremental star-schema loading expressed as Spark DataFrame operators."""
