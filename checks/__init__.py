"""Registered queries on the driver tables, each with an SQL twin where SQL can say it."""

from checks.registry import ORACLES, QUERIES  # noqa: F401
from checks import cells, countries, series, stored, zoning  # noqa: F401  (register on import)
