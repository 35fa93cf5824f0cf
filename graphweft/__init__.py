"""Knowledge-graph extraction, maintenance and hybrid retrieval as Spark jobs."""

import sys

from pyspark import cloudpickle

from graphweft.schema import KnowledgeGraph

# The few functions that run in Python workers travel with the tasks, so that
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["KnowledgeGraph"]
