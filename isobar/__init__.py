"""Weather time-series analytics on Spark.

Functions of this package that run in Python workers are sent together with
their code, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
