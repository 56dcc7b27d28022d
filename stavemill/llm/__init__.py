"""Operators for preparing language-model training data. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage that run inside tasks travel with the plan, so that executors need
# no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
