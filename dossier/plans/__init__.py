"""Named queries over the driver tables, each with an independent SQL statement of its result."""


def all_queries():
    """(queries, SQL) by name."""
    import importlib
    import pkgutil

    from . import registry
    for m in pkgutil.iter_modules(__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.ORACLES
