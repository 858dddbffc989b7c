"""Operators of a training-data pipeline: filters, near-duplicate search, archives, mixing.

Nothing else in the library imports this package.  Functions that run inside Python
workers are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
