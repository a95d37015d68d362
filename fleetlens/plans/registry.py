"""Registered queries: name, Spark function of (spark, folder), and SQL for the same rows."""

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def with_views(*views, select):
    """A SQL text of common table expressions followed by a SELECT."""
    return "WITH " + ",\n".join(views) + "\n" + select
