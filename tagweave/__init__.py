"""Retrieval-based record tagging as Spark jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions of this package travel to executors inside the task closure,
# so a cluster needs no copy of the package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
