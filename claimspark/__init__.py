"""Claims-denial analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with the job, so no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
