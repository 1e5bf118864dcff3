"""Model-failure analytics as DataFrame operators on Spark.

The few functions that run in Python workers are pickled by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
