"""Training-data operators: one module for each, plus ``registry`` with their queries and SQL.

Nothing outside this subpackage imports it.
"""
