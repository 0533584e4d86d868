"""Daily weather-series analytics as Spark jobs.

The few Arrow functions of this package are pickled by value, so executors
need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
