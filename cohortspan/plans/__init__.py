"""Registered queries over the driver's tables, each with a check in ANSI SQL."""
