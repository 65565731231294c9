"""Registered queries and the SQL that checks them."""

from catalog import fixtures

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register ``f(spark, sf_dir) -> DataFrame``; ``sql`` is the same result for DuckDB."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Tables that a check can name, with the tables they are built from.
_CTES = {
    "businesses": (fixtures.business_sql(), []),
    "business_core": (fixtures.business_sql(False), []),
    "page_specs": (fixtures.page_sql(), ["business_core"]),
    "rendered": (fixtures.rendered_sql(), []),
    "feedback": (fixtures.feedback_sql(), []),
    "attempts": (fixtures.attempts_sql(), []),
    "status_log": (fixtures.status_sql(), []),
    "raw_responses": (fixtures.responses_sql(), []),
}


def over(text, *names, **more):
    """Put the named fixture tables in front of a statement; ``more`` are further tables, in order."""
    parts = {}

    def need(name):
        body, before = _CTES[name]
        for other in before:
            need(other)
        parts[name] = body

    for name in names:
        need(name)
    parts.update(more)
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts.items()) + "\n" + text


def joined(items, mark=", "):
    return mark.join(items)
