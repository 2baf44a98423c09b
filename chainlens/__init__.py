"""Verification and analysis of hash-chained, signed audit logs as ordinary Spark jobs."""

__version__ = "0.1.0"
