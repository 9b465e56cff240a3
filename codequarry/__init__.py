"""Code-knowledge, retrieval and content-curation analytics on Spark DataFrames."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Arrow functions travel to executors by value, so no package install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
