"""textloom: corpus analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so executors need not have it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
