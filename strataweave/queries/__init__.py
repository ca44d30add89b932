"""Queries on the bound tables, with the SQL that each must agree with."""
