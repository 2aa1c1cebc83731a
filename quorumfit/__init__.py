"""Consensus logistic regression, its evaluation and experiment tables on Spark."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
