"""tidewatch: competitive-intelligence jobs over landed tables, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task helpers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
