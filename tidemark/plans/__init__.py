"""Registered queries and the SQL that they must equal."""
