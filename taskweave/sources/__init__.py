"""Sources and sinks.  Functions that run inside Python workers are pickled by value, so executors need no copy."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
