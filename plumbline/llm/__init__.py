"""Operators of a training-data pipeline. Nothing else in the library imports this.

Functions of this package travel to the workers by value, so that a cluster need
not have the package installed on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
