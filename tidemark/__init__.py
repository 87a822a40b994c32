"""Tidemark: multi-run drift analytics and training-data preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
