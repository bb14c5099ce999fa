"""Tessella: a PySpark-native analytics engine for staged, versioned data pipelines."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole, so these need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
