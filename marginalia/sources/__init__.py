"""Readers of semi-structured records: delimited tables, MARC in XML and JSON, shop and list pages."""
