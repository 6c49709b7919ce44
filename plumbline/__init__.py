"""plumbline: code-quality analytics for many repositories, as Spark jobs."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# The few functions that run in workers travel by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
