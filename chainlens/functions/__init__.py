"""Scalar functions: hashes, signatures, canonical JSON, and text as Spark columns."""
