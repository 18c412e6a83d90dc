"""Lot-relative parametric screening as Spark DataFrame operators."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions of this package travel to the workers by value, so executors need no copy of it on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
