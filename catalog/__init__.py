"""Registered queries: each operator over whole test tables, with the SQL that must give the same rows."""
