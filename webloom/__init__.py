"""webloom: captured web content as DataFrames, queried with Spark."""

import sys

from pyspark import cloudpickle

# Executors may lack this package on their path: functions of it travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
