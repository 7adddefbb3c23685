"""Operators of a training-data pipeline over a table of documents, and their queries."""

from pyspark import cloudpickle

import logweave

# Python workers need not find the package: what runs there travels by value.
cloudpickle.register_pickle_by_value(logweave)
