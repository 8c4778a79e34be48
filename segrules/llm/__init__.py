"""Operators for preparing training data: one module per operator, queries and SQL beside them.

Nothing else in the library imports this subpackage; it may import the library's general helpers.
Functions that run in Python workers are shipped by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
