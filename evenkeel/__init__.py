"""Analytics on Spark whose results do not depend on partitioning, row order or retries."""

import sys

from pyspark import cloudpickle

# The few Python functions travel with their tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
