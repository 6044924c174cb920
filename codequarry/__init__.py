"""codequarry: search, maintenance and analytics over indexed source code, as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get this package's functions with the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
