"""Variant-effect analytics as Spark DataFrame operators.

Functions sent to executors are pickled with their code, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
