"""Operators for preparing training text; nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so executors need no copy of this folder
cloudpickle.register_pickle_by_value(sys.modules[__name__])
