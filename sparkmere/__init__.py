"""Retrieval analytics on Spark: set-oriented operators over documents, vectors, graphs, tags and logs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to executors by value, so that a cluster needs no copy of it.
register_pickle_by_value(sys.modules[__name__])
