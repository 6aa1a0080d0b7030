"""Evidence retrieval and review analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
