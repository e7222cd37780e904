"""lodestone: document retrieval on Spark DataFrames.

Collections of text documents with free-form metadata and embedding vectors
are DataFrames; every operator takes DataFrames and returns a DataFrame, and
answers many queries in one job.
"""

import sys

from pyspark import cloudpickle

# Arrow kernels travel inside the task closure, so executors need no installed
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
