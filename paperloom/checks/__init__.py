"""Registered queries over the test tables, each with its DuckDB counterpart."""


def all_queries():
    """``(queries, oracles)`` by name."""
    from paperloom.checks import q_replies, q_select, q_state, q_store, q_text, q_views  # noqa: F401
    from paperloom.checks.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
