"""Operators for preparing language-model training data.

Functions of this package travel to the executors by value, so a cluster needs
no copy of the package beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
