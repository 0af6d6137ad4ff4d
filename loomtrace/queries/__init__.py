"""Registered queries, one module per operator family; each exports ``QUERIES`` and ``SQL``."""
