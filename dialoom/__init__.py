"""Text analytics over dialogue and document tables, expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
