"""Spark-native analytics for catalogues of places: scoring, search, reports, text rules, spatial joins, streaming."""
