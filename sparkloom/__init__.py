"""Analytics, machine learning and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors whole, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
