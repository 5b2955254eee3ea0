"""Leak-free match analytics and outcome forecasting as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
