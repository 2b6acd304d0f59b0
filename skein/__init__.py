"""Skein: Spark-native operators for evolving event sessions, retrieval and change-point analytics.

Functions that run in Python workers are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
