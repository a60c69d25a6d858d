"""Operators for preparing training text and vectors at scale."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions travel to the executors by value, so those need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
