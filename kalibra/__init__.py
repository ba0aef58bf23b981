"""A PySpark-native engine for bias-calibrated evidence analytics.

Worker functions are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
