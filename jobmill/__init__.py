"""Job-market analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions with their tasks, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
