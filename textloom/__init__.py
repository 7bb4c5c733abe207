"""textloom: corpus cleaning, vocabularies, training examples and metrics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no installed copy: the few functions that run in Python workers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
