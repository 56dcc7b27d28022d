"""Registered queries and the ANSI SQL they are checked against."""
