"""Profiling of databases into a plain-text index, on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions and classes by value and need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
