"""Early-warning analytics for fleets of devices that report once a day, on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few functions that run in Python tasks travel with the task, so that executors need no copy of
# this package.
register_pickle_by_value(sys.modules[__name__])
