"""Scalar functions: Spark expressions where exact, Python where only Python's semantics will do."""
