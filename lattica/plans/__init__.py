"""Schemas, the derived views, named SQL queries and the registry of all queries."""
