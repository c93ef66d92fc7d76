"""logwarden: finding attacks in system logs with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Tasks carry our helper functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
