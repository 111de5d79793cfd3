"""Queries over the driver's tables, each next to the SQL it has to agree with."""


def all_checks():
    from . import lookups, registry, search, sync, words  # noqa: F401
    from . import lifecycle  # noqa: F401  (its SQL uses steps that the others define)
    return registry
