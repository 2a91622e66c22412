"""Depth-log analytics as PySpark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions handed to Arrow workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
