"""hyperloom: hyperdimensional analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Task functions travel with their plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
