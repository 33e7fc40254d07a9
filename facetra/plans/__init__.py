"""Registered queries, their SQL and publishing."""
