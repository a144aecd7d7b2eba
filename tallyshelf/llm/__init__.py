"""Operators for preparing training text: de-duplication, filters, mixing, search and tokens.

Functions that run inside tasks are sent by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
