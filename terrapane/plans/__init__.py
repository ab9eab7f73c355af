"""Catalog tables and the registered queries."""
