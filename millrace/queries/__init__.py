"""Queries over the given tables, one or more for every operator, each with the SQL
that an independent engine runs to check it."""

from millrace.queries import checks, files, reports, sql, transforms

_MODULES = (transforms, checks, files, sql, reports)


def all_queries():
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def all_oracles():
    return {
        name: text.strip()
        for module in _MODULES
        for name, (_, text) in module.QUERIES.items()
        if text
    }
