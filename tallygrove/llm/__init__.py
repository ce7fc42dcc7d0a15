"""Operators for training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions that run in tasks travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
