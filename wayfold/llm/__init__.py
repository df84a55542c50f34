"""Operators for preparing training data at scale, each one a Spark job of its own."""
