"""Corpus preparation, retrieval, conversation and evaluation jobs on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so the package does
# not have to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
