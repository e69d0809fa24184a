"""News-coverage and media-ownership analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run inside tasks travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
