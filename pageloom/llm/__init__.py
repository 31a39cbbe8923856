"""Operators of a training-data pipeline over tables of documents.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# The helpers travel with the plan: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
