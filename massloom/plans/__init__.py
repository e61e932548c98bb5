"""Registered queries over the driver's tables, each beside its ANSI-SQL twin."""
