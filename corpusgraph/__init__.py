"""corpusgraph: document collections as concept and document graphs, on Spark.

The package is pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
