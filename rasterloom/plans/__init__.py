"""Queries composed of operators, with the SQL that checks them."""
