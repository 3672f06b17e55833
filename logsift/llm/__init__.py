"""Operators of a training-data pipeline over documents, vectors and conversations."""

import sys

from pyspark import cloudpickle

# Functions travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
