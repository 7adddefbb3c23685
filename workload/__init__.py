"""Registered queries: adapters from the driver's tables, query bodies and their SQL oracles."""

from pyspark import cloudpickle

import logweave

from . import queries, streams  # noqa: F401
from .registry import ORACLES, QUERIES

# Python workers need not find the package: its few functions that run there travel by value.
cloudpickle.register_pickle_by_value(logweave)

__all__ = ["ORACLES", "QUERIES"]
