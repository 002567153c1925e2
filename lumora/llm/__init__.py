"""Operators of a training-data pipeline over document, page and embedding tables.

Nothing outside this subpackage imports it; ``registry`` holds its queries and their SQL.
"""
