"""Code-graph analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors with their code: a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
