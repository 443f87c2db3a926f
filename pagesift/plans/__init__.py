"""Bindings of operators to tables, with the SQL that checks them."""
