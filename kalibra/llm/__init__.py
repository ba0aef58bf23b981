"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Worker functions are pickled by
value, so executors need the third-party wheels but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
