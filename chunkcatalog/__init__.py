"""A PySpark-native analytics engine over a content-addressed, versioned chunk catalog."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
