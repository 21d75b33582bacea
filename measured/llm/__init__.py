"""Operators for large text corpora.

Nothing else in the library imports this subpackage; ``queries.py`` registers
its queries with the driver's entry module.
"""
