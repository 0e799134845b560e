"""Spark-native analytics over planetary imagery catalogs, match tables, rasters and run histories."""

import sys

from pyspark import cloudpickle

# functions go to the workers by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
