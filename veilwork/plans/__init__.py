"""Registered queries of the engine's own operators."""

from veilwork.plans import pages, pictures, placing, redaction, words

MODULES = (redaction, words, pages, pictures, placing)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.query.queries.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.query.sql.items()}
