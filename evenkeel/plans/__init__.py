"""The catalogue: each operator as a query over the given tables, with SQL for the same result."""

from . import folding, integrity, models, ordering, records, sampling, statistics, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
