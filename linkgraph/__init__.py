"""Spark-first analytics over hyperlinked document collections."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so the package is needed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
