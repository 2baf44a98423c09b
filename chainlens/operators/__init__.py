"""Operators over records: decoding, checks, adjacency, chain roots, inspection, export, sealing."""
