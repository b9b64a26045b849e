"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan, so workers need not have the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
