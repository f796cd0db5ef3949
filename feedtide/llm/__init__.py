"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# the functions that run in tasks travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
