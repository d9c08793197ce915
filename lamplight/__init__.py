"""Spark-first corpus building and evaluation library."""
import sys

from pyspark import cloudpickle

# Executors get the code with each task, wherever the driver was started from.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
