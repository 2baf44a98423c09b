"""Whole verifications: the lenient and the strict profile, and their reports."""
