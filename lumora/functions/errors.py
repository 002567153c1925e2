class QueryError(ValueError):
    """A query or parameter that is malformed or beyond the supported subset."""
