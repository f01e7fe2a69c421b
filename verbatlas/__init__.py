"""Spark-first analytics over timed transcripts, documents and library entries."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the functions themselves, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
