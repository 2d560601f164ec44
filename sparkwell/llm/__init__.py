"""Operators of a training-data pipeline.  Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Ship these functions by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
