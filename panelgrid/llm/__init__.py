"""Operators for preparing training text.

Functions that run in Python workers travel by value, so executors need only the installed
libraries, not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
