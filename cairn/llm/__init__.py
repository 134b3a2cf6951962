"""Operators that prepare training text: filters, dedup joins, tokenisation, classifiers and extraction.

Nothing outside this subpackage imports it. `queries.py` lists the queries and their SQL.
"""
