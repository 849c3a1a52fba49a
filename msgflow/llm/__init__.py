"""Operators that prepare large text collections for training language models.

Each module holds one operator with a general interface; ``queries`` applies
them to the given tables.  Nothing outside this package imports it.

Functions that run in Python workers are sent by value, so executors need not
have this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
