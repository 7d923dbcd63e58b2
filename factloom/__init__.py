"""Dependency-fact analytics on Spark.

Facts and rules are DataFrames; every check is a plan from facts to findings.
Functions that run in Python workers are pickled by value, so executors need no
installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
