"""Compositions of operators: adapters, pipelines and the registered queries."""


def all_queries() -> tuple[dict, dict]:
    """The registered queries and their oracle SQL."""
    from loompanel.plans import feature_queries, panel_queries, registry  # noqa: F401  importing registers

    return registry.QUERIES, registry.ORACLES
