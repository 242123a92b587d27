"""Operators for training-data pipelines on Spark DataFrames.

Nothing else in the package imports this one.  Functions that run in Python workers
are pickled by value, so that executors need this package's dependencies (numpy,
pyarrow, tokenizers) but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
