"""All named queries of the engine, each with the SQL of the same name in capitals where SQL can say it."""

from __future__ import annotations

from factloom.plans import evidence, inputs, manyreports, mechanisms, reports, rules, spans, state, webpages

_MODULES = (spans, webpages, evidence, state, rules, reports, manyreports, inputs, mechanisms)
QUERIES = {f.__name__: f for m in _MODULES for f in m.QUERIES}
ORACLE_SQL = {f.__name__: getattr(m, f.__name__.upper()) for m in _MODULES for f in m.QUERIES if hasattr(m, f.__name__.upper())}
