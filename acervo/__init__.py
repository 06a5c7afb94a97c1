"""Document curation, evidence building and hybrid retrieval as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions that run in workers travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
