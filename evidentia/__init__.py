"""Evidence analytics on Spark: operators over items, components and evidence, as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so nothing needs to be installed or added there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
