"""Operators for preparing training corpora, built on Spark DataFrames.

Functions of this package that run inside tasks are shipped with the job, so executors need the
third-party libraries but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
