from . import cells, filters, flows, missing, nan, noise, profiles, rules, tables, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
