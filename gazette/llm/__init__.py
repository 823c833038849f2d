"""Operators of a training-data pipeline (HTML, scoring, de-duplication, rules, sharding, formatting, tokens).

Nothing else in the library imports this subpackage. Queries over whole
tables are in ``registry``; each operator module has its own general API.
"""
