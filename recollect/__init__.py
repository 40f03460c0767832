"""Find, refine, explain and act on remembered items, as PySpark jobs."""

import sys

from pyspark import cloudpickle

from recollect.session import build_session

# Functions of this package travel to the executors by value: nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
