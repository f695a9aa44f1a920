"""docflow: document analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a
# cluster need not have the package installed on every machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
