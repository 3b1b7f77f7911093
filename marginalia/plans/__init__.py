"""Registered queries: each operator over the driver's tables, with the same question in SQL."""
