"""Named queries of the engine."""


def load():
    """The registry with every module's queries."""
    from . import browse, charters, classify, decisions, dedupe, geometry, planning, projections, quality, rates, registry, retrieval, stores, structure, tickets  # noqa: F401

    return registry
