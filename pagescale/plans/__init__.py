"""Views on the given tables and the queries registered over them."""

import importlib
import pkgutil


def all_queries():
    from pagescale.plans import registry
    for m in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.endswith("_queries")):
        importlib.import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.ORACLE
