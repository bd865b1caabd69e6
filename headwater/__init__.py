"""Headline and trend analytics, and training-data operators, as Spark plans.

Functions of this package reach the executors by value, so they need no copy of it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
