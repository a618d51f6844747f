"""Registered queries: operators applied to the domain tables, each with the SQL its result is checked against."""
