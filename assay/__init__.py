"""Data-integrity operators for Spark: list, digest, compare, copy, and account for every entry."""
